"""Main text of web pages by consensus host paths.

Each page's containers are scored: the characters of their text blocks, less twice those in links. The deepest container with four
fifths of the page's worth is lifted to the article or main element around it, else over parents that hold paragraphs of their own; its path,
generalised to tags and classes without digits, is the page's vote. Votes are counted per host in Spark, and every page is then
extracted at its host's winning path; where that holds less than an eighth of the worth of a page's own best container, at the latter.

Left out: navigation, header, footer, aside, script and style elements, hidden parts and what browsers don't show (templates, contents of frames). A header within an article is left
out too, but for its headings. An element whose class or id names a menu, sidebar, notice, advert, form or comment is only suspect: it goes where its content agrees with its name. Within an
article or main element, one goes if it is mostly links, or if its name is a whole class (``ad``) and it has no more text than the article has beside it; comments and forms go unless there is
nothing beside them. Elsewhere suspects go if any article stands outside them; without one, those of one name stay if they aren't mostly links and hold more than the
other text: once as much for part of a name (``ad-box``), four times for a whole name, eight times for comments. What a kept one holds is judged in the same way. A part of a name doesn't count
beside a class that names content (``post``) or with a qualifier (``no-sidebar``, ``comments-open``), and a whole one counts as a part there.
Character references are decoded, white space within a block is one space, blocks are joined by one newline; nothing else is dropped.

A page is read once from left to right, in time linear in its length however it is nested or broken: a comment that never ends takes the rest of the page; after a
tag whose quotes never end, tags end at their first ``>``; a ``<`` without any ``>`` behind it is text. Null and empty html give an empty text; a page without any
block too. Pages of null urls share the host "". Repeated page ids are rows of their own. Hosts whose votes tie take the path that
comes first. Columns ``text`` and ``n_chars`` are replaced, all others kept, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkfolio.llm.common import join_small, table
from sparkfolio.llm.url_filter import host

_BLOCK = frozenset(
    "html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption address hr header footer nav aside form fieldset details summary center menu dialog".split()
)
_SKIPPED = frozenset("head nav header footer aside menu button select noscript template canvas svg dialog".split())
#: Elements whose contents are no markup; they end at their own end tag only.
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in ("script", "style", "textarea", "iframe", "title")}
_VOID = frozenset("hr br img input meta link source wbr area base col embed param track".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text, which are no containers.
_LEAVES = frozenset("p li td th dt dd".split()) | _HEADINGS
#: A start tag of the key ends an open element of these, if no other container is between.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_WORDS = (
    "nav|navs|navbar|navigation|navmenu|menus?|breadcrumbs?|header|masthead|footer|side[-_]?bars?|ads?|advert|adverts|advertisements?|advertising|sponsor|sponsors|sponsored|promo|promos|promotions?|"
    "banners?|cookies?|consent|gdpr|notices?|alerts?|pop[-_]?ups?|modal|comments?|commentlist|commentform|respond|replies|disqus|share|sharing|social|related|recommended|recommendations?|"
    "newsletter|subscribe|subscription|signup|login|widgets?|pagination|pager|skip[-_]?links?"
)
_NOISE = re.compile(rf"(?:^|[-_])(?:{_WORDS})(?:$|[-_])")
_SURE_NOISE = re.compile(_WORDS)
_CONTENT = frozenset("content post entry story article main body text page page-content post-content entry-content article-content article-body post-body main-content".split())
_QUALIFIERS = frozenset("no has with without is not".split()), frozenset("open closed enabled disabled on off none".split())
_COMMENT = re.compile("(?:comments?|commentlist|replies|disqus)(?:[-_].*)?")
_ROLES = frozenset("navigation banner contentinfo complementary search".split())
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: The rest of a tag; quotes count after an equals sign only, and only if they end.
_TAIL, _PLAIN_TAIL = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>"), re.compile(r"([^>]*+)>")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_DIGITS = re.compile(r"\d+")
#: How an element is looked at: as any other, suspect by part of a name, by a whole name, as a comment or form, or not at all. How many times the other text suspects must hold.
_PERHAPS, _SURE, _FOREIGN, _HIDDEN = 1, 2, 3, 4
_TIMES = {_PERHAPS: 1, _SURE: 4, _FOREIGN: 8}
#: The share of a page's own best container that the host's winning path must hold.
_SHARE = 8


def _noise(names: list[str], tag: str) -> int:
    """Whether class names or an id say boilerplate: 0, _PERHAPS (part of a name), _SURE (a whole name) or _FOREIGN (comments)."""
    if tag in ("html", "body", "main"):
        return 0
    level, content = 0, False
    for name in names:
        name = name.lower()
        if name in _CONTENT:
            content = True
            continue
        whole = _SURE_NOISE.fullmatch(name)
        if whole or _NOISE.search(name):
            parts = re.split(r"[-_]+", name)
            if parts[0] in _QUALIFIERS[0] or parts[-1] in _QUALIFIERS[1]:
                continue
            found = _FOREIGN if _COMMENT.fullmatch(name) else _SURE if whole else _PERHAPS
            if found == _FOREIGN or tag != "article":
                level = max(level, found)
    if content:
        return _PERHAPS if level == _SURE else level if level == _FOREIGN else 0
    return level


def _marks(tag: str, raw: str) -> tuple[str, int]:
    """(generalised name, how surely it is boilerplate) of an element."""
    if not raw or "=" not in raw and "hidden" not in raw.lower():
        return tag, 0
    found = {}
    for k, a, b, c in _ATTRIBUTE.findall(raw):
        found.setdefault(k.lower(), a or b or c)
    classes = found.get("class", "").split()
    level = max(_noise(classes, tag), _noise([found["id"]], tag) if found.get("id") else 0)
    if "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("role", "").lower() in _ROLES:
        level = _HIDDEN
    return ".".join([tag, *sorted({n for c in classes if (n := _DIGITS.sub("", c))})]), level


@dataclass
class _Page:
    """A page's containers as numbered nodes (0 is the page itself; a parent comes before its children) and its text blocks in order."""

    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    name: list[str] = field(default_factory=lambda: [""])
    holder: list[int] = field(default_factory=lambda: [0])  # the node itself, or the container around running text
    level: list[int] = field(default_factory=lambda: [0])  # how suspect the node itself is
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # node, text, characters in links

    def add(self, above: int, tag: str, name: str, level: int) -> int:
        node = len(self.parent)
        self.parent.append(above)
        self.tag.append(tag)
        self.name.append(name)
        self.holder.append(self.holder[above] if tag in _LEAVES else node)
        self.level.append(level)
        return node

    def summed(self, own: list[int]) -> list[int]:
        for node in range(len(own) - 1, 0, -1):
            own[self.parent[node]] += own[node]
        return own

    def settled(self) -> _Page:
        """The page without the blocks of suspect elements, but for those that must be its text.

        Each round keeps some of the outermost suspects and those inside them that hold four fifths of one, and looks again; each kept share is a multiple of what was there, so rounds are few.
        """
        if not any(self.level):
            return self
        nodes = range(1, len(self.parent))
        article = [0] * len(self.parent)
        size, links = [0] * len(self.parent), [0] * len(self.parent)
        for n in nodes:
            article[n] = n if self.tag[n] in ("article", "main") else article[self.parent[n]]
        for n, text, link in self.blocks:
            size[n] += len(text)
            links[n] += link
        self.summed(size)
        self.summed(links)
        while True:
            outer, within = [0] * len(self.parent), [0] * len(self.parent)  # the outermost suspect around a node; the article around that
            for n in nodes:
                above = self.parent[n]
                outer[n] = outer[above] or (n if self.level[n] else 0)
                within[n] = within[above] if outer[above] else article[above]
            beside, prose, articles, held = Counter(), 0, 0, Counter()
            for n, text, link in self.blocks:
                if not outer[n]:
                    worth = max(0, len(text) - 2 * link) if self.tag[n] not in _HEADINGS else 0
                    prose += worth
                    beside[article[n]] += worth
                    articles += article[n] > 0
                elif article[n] and not within[outer[n]]:
                    held[outer[n]] += 1
            kept = self._kept({o for n, _, _ in self.blocks if (o := outer[n])}, within, size, links, beside, prose, articles, held)
            if not kept:
                self.blocks = [b for b in self.blocks if not outer[b[0]]]
                return self
            for n in nodes:
                if outer[n] in kept and self.level[n] and (n in kept or 5 * size[n] >= 4 * size[outer[n]]):
                    self.level[n] = 0

    def _kept(self, suspects, within, size, links, beside, prose, articles, held) -> set[int]:
        """The suspects that stay, of the outermost ones."""
        linked = lambda n: self.tag[n] != "form" and 2 * links[n] >= size[n]
        kept, groups = set(), {}
        for n in suspects:
            level, rest = self.level[n], beside[within[n]]
            if within[n]:
                if rest == 0 if level == _FOREIGN else not linked(n) and (level == _PERHAPS or size[n] > rest):
                    kept.add(n)
            elif not linked(n):
                groups.setdefault((level, self.name[n]), []).append(n)
        if kept or articles:
            return kept
        whole = sum(held.values())
        able = []
        for (level, name), found in groups.items():
            most = sum(size[n] for n in found)
            if most > _TIMES[level] * prose and whole == sum(held[n] for n in found):
                able.append((level < _FOREIGN or self.tag[found[0]] == "form", most, name, found))
        return set(max(able)[3]) if able else kept

    def best(self) -> int:
        """The node that holds the article; 0 if no container is worth anything."""
        own, direct = [0] * len(self.parent), set()
        for node, text, link in self.blocks:
            holder = self.holder[node]
            own[holder] += len(text) - 2 * link
            if len(text) > 2 * link:
                direct.add(holder)
                if self.tag[node] == "h1":
                    direct.add(-holder)
        scores = self.summed(own)
        if scores[0] <= 0:
            return 0
        node, most = 0, scores[0]
        deeper = {}
        for n in range(1, len(scores)):
            if self.tag[n] not in _LEAVES and 5 * scores[n] >= 4 * most:
                deeper[self.holder[self.parent[n]]] = n  # at most one child can hold as much, unless links count against others
        while node in deeper:
            node = deeper[node]
        around = node
        while around and self.tag[around] not in ("article", "main"):
            around = self.parent[around]
        if around:
            return around
        while (up := self.holder[self.parent[node]]) and (-up in direct or up in direct and self.tag[up] not in ("body", "html")):
            node = up
        return node

    def path(self, node: int) -> str:
        names = []
        while node:
            names.append(self.name[node])
            node = self.parent[node]
        return ">".join(reversed(names))

    def below(self, chosen: list[bool]) -> list[tuple[int, str, int]]:
        """The blocks in or below the chosen nodes."""
        for n in range(1, len(chosen)):
            chosen[n] = chosen[n] or chosen[self.parent[n]]
        return [b for b in self.blocks if chosen[b[0]]]

    def at_path(self, path: str) -> list[tuple[int, str, int]]:
        names = path.split(">")
        matched, chosen = [0] + [-1] * (len(self.parent) - 1), [False] * len(self.parent)
        for n in range(1, len(self.parent)):
            depth = matched[self.parent[n]]
            if 0 <= depth < len(names) and names[depth] == self.name[n]:
                matched[n] = depth + 1
                chosen[n] = depth + 1 == len(names)
        return self.below(chosen)

    def at_node(self, node: int) -> list[tuple[int, str, int]]:
        chosen = [False] * len(self.parent)
        chosen[node] = True
        return self.below(chosen)

    def text(self, winner: str | None = None) -> str:
        """The text at the host's winning path; that of the page's own best container where the path holds none, or less than an eighth of that one's worth."""
        worth = lambda blocks: sum(len(text) - 2 * link for _, text, link in blocks)
        own = self.at_node(self.best())
        shared = self.at_path(winner) if winner else []
        return "\n".join(text for _, text, _ in (shared if shared and _SHARE * worth(shared) >= worth(own) else own))


def read(page: str | None) -> _Page:
    """The containers and the text blocks outside boilerplate of a page."""
    found = _Page()
    page = page or ""
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, node, whether skipped from here on
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, in_link, at, start, tail = 0, False, 0, 0, _TAIL

    def flush():
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                found.blocks.append((stack[-1][1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop():
        opened[stack.pop()[0]] -= 1

    while True:
        start = page.find("<", start)
        m = None
        if start >= 0:
            following = page[start + 1 : start + 2]
            if following in ("!", "?"):
                comment = page.startswith("<!--", start)
                end = page.find("-->" if comment else ">", start + (2 if comment else 1))
                end = len(page) if end < 0 else end + (3 if comment else 1)
            else:
                m = _NAME.match(page, start)
                if m is None:
                    start += 1
                    continue
                rest = tail.match(page, m.end())
                if rest is None:
                    tail = _PLAIN_TAIL
                    rest = tail.match(page, m.end())
                if rest is None:
                    start = -1
                else:
                    end = rest.end()
        stop = start if start >= 0 else len(page)
        if stop > at and not stack[-1][2]:
            parts.append(page[at:stop])
            linked += (stop - at) * in_link
        if start < 0:
            break
        at = start = end
        if m is None:
            continue
        closing, tag, raw = m[1], m[2].lower(), rest[1]
        if not closing and tag in _RAW:
            ended = _RAW[tag].search(page, at)
            at = start = ended.end() if ended else len(page)
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not closing and "href" in raw.lower()
        is_block = tag in _BLOCK
        if tag in _VOID and tag != "hr" or not is_block and tag not in _SKIPPED:
            continue
        if is_block:
            flush()
        if closing:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag == "body":
            while stack[-1][0] == "head":
                pop()
        elif is_block and stack[-1][0] == "p":  # a paragraph ends where any block begins
            pop()
        while tag in _ENDS and stack[-1][0] in _ENDS[tag]:
            pop()
        if tag == "hr" or raw.endswith("/") and tag == "svg":
            continue
        name, noise = _marks(tag, raw)
        above, node, below = stack[-1]
        in_article = opened["article"] or opened["main"]
        skipped = below or noise == _HIDDEN or tag in _SKIPPED
        if tag == "header" and in_article and not below and noise < _SURE:
            name = "header+" + name
        elif tag in _HEADINGS and above == "header" and found.name[node].startswith("header+"):
            skipped = noise == _HIDDEN  # a heading in an article's own header
        stack.append((tag, found.add(node, tag, name.replace(">", ""), 0 if skipped else _FOREIGN if tag == "form" else noise), skipped))
        opened[tag] += 1
    flush()
    return found.settled()


@F.pandas_udf(StringType())
def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The path of a page's best container; null without any."""
    for pages in batches:
        yield pd.Series([p.path(p.best()) or None for p in map(read, pages)], dtype=object)


@F.pandas_udf(StringType())
def text_at(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A page's text, given the winning path of its host."""
    for pages, winners in batches:
        yield pd.Series([read(page).text(winner) for page, winner in zip(pages, winners, strict=True)], dtype=object)


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``."""
    at = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    votes = at.select("host", vote("html").alias("path")).where(F.col("path").isNotNull()).groupBy("host", "path").count()
    order = Window.partitionBy("host").orderBy(F.desc("count"), "path")
    winners = votes.withColumn("n", F.row_number().over(order)).where(F.col("n") == 1).select("host", F.col("path").alias("winner"))
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host(F.col(url_col)).alias("host"))
    dealt = join_small(rows, winners, ["host"])
    out = dealt.withColumn("text", text_at(F.col(f"row.`{html_col}`"), F.col("winner")))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "text", F.length("text").cast("long").alias("n_chars"))


def op10_main_text(spark, sf_dir) -> DataFrame:
    """Main text of every page, from its whole html."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
