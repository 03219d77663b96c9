"""URL filters, WARC bundles and main text."""

import base64
import hashlib
import io
import math
import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from sparkfolio.llm import html_extract, url_filter, warc
from sparkfolio.llm.common import shared_dir

PAGE = "page_id long, url string, html string"


def test_rules_and_parts(spark):
    urls = {
        1: "http://WWW.Example.com/en/a?b#c", 2: "https://x.example.com/en/", 3: "https://a.net/es/1", 4: "https://net/fr/", 5: "https://a.net/de/", 6: None, 7: "no scheme",
        8: "http://notexample.org", 9: "x://evil.com#/", 10: "http://a.com/x://b.net/es/", 11: "http://a.net?/es/", 12: "http://É.COM/EN/",
    }
    pages = spark.createDataFrame([(i, u, "old") for i, u in urls.items()], "page_id long, url string, rule string")
    none = spark.createDataFrame([], "host string, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, none).collect()}
    assert got == {
        1: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 2: ("x.example.com", "/en/", "example.com/en/", "block"), 3: ("a.net", "/es/1", "net/es/", "block"),
        4: ("net", "/fr/", "net/fr/", "block"), 5: ("a.net", "/de/", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("notexample.org", "", None, "allow"),
        9: ("evil.com", "", None, "allow"), 10: ("a.com", "/x://b.net/es/", "com/", "allow"), 11: ("a.net", "", None, "allow"), 12: ("É.com", "/EN/", "com/", "allow"),
    }


def test_rules_of_a_table_equal_those_of_a_list(spark):
    rng = random.Random(6)
    names = ["com", "net", "a.com", "b.a.com", "x.net", "com.net", ""]
    paths = ["/", "/en/", "/en", "/fr/x", "", "/e"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in names[:6] for p in rng.sample(paths, 4)] + [("com", "/", "block"), ("com", "/", "allow")]
    urls = [f"http://{rng.choice(['', 'www.', 'b.'])}{rng.choice(names)}{rng.choice(paths)}{rng.choice(['', '1/', 'en/'])}" for _ in range(200)] + [None, "none"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "host string, bad int")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
    shown = lambda df: sorted((r.page_id, r.rule, r.verdict) for r in df.collect())
    by_list = shown(url_filter.judge(pages, none, rules=rules))
    assert shown(url_filter.judge(pages, none, rules=table)) == by_list and sum(r is not None for _, r, _ in by_list) > 50
    assert shown(url_filter.judge(pages, none, rules=table.limit(0))) == shown(url_filter.judge(pages, none, rules=()))
    with pytest.raises(ValueError):
        url_filter.matched_rule(F.lit("a"), F.lit("b"), [("a", "/", "block")] * 1001)


def test_reputation_blocks_bad_hosts_and_shrinks_small_ones(spark):
    rng = random.Random(1)
    rows = [("spam.bad.org", 1)] * 60 + [("tiny.good.org", 1)] + [(f"h{i}.good.org", int(rng.random() < 0.05)) for i in range(40) for _ in range(20)] + [("x.good.org", None)]
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    hosts = ["spam.bad.org", "tiny.good.org", "h1.good.org", "new.bad.org", "new.good.org", "else.info"]
    pages = spark.createDataFrame([(i, f"http://{h}/de/1", None) for i, h in enumerate(hosts)], PAGE)
    got = {r.host: (r.verdict, r.not_worse) for r in url_filter.judge(pages, outcomes, rules=()).collect()}
    assert got["spam.bad.org"][0] == "block" and got["tiny.good.org"][0] == "allow" and got["else.info"][0] == "allow"
    assert got["tiny.good.org"][1] > got["new.bad.org"][1]


@pytest.mark.parametrize("a, b", [(0.3, 1.7), (2.6, 4.2), (107.0, 251.0), (12.0, 0.4), (4000.0, 9000.0), (250_000.0, 749_000.0)])
@pytest.mark.parametrize("limit", [0.02, 0.249, 0.29, 0.9])
def test_beta_posterior(spark, a, b, limit):
    """Against the density, summed on a fine grid; below a = 1 on one of u = (x / limit) ** a, which takes its pole at 0."""
    got = spark.range(1).select(url_filter.not_worse(F.lit(a), F.lit(b), limit).alias("p")).first().p
    if a / (a + b) <= limit:
        assert got == 1
        return
    grid = (np.arange(4_000_000) + 0.5) / 4_000_000
    if a < 1:
        logs, scale = (b - 1) * np.log1p(-limit * grid ** (1 / a)), a * math.log(limit) - math.log(a)
    else:
        logs, scale = (a - 1) * np.log(limit * grid) + (b - 1) * np.log1p(-limit * grid), math.log(limit)
    top = logs.max()
    want = math.exp(scale - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b) + top) * np.exp(logs - top).mean()
    assert got == pytest.approx(want, rel=1e-3, abs=1e-12)


def test_url_filter_edges(spark):
    """Public suffixes of a table, clashing columns, repeated and very long urls, an empty table."""
    rows = [("a.shop.co.uk", 1)] * 30 + [("b.shop.co.uk", 1)] * 30 + [(f"x{i}.fine.co.uk", 0) for i in range(200)] + [("fine.org", 0)] * 50
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    suffixes = spark.createDataFrame([("co.uk",), ("uk",), ("org",), (None,)], "suffix string")
    urls = ["http://new.shop.co.uk/", "http://new.fine.co.uk/", "http://co.uk/", "http://uk/", "http://new.org/", "http://new.shop.co.uk/" + "x" * 1_000_000, None]
    pages = spark.createDataFrame([(i % 7, u, f"keep {i}") for i, u in enumerate(urls * 2)], "page_id long, url string, _host string").withColumn("won", F.lit(3)).withColumn("size", F.lit(4)).withColumn("row", F.lit(5))
    got = url_filter.judge(pages, outcomes, rules=(), suffixes=suffixes)
    assert {"page_id", "url", "_host", "won", "size", "row", "host", "path", "rule", "verdict", "not_worse"} == set(got.columns)
    kept = got.collect()
    assert len(kept) == 14 and {(r.won, r.size, r.row) for r in kept} == {(3, 4, 5)} and {r._host for r in kept} == {f"keep {i}" for i in range(14)}
    assert {r.page_id: r.verdict for r in kept} == {0: "block", 1: "allow", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow"}
    without = {r.page_id: r.verdict for r in url_filter.judge(pages, outcomes, rules=()).collect()}
    assert without[0] == without[1]  # one domain, co.uk, without the table
    assert url_filter.judge(pages.limit(0), outcomes).count() == 0


def warc_rows(n=300):
    rng = random.Random(2)
    return [(i, f"http://h/{i}\r\n%", rng.choice([None, "", "same", "same", f"own {i} é\r\n\r\nx" * rng.randrange(1, 200)])) for i in range(n)] + [(7, "again", "same"), (None, None, "null id")]


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, tmp_path, monkeypatch, least):
    monkeypatch.setattr(warc, "FRAME_BYTES", 20_000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 3_000)
    rows = warc_rows()
    index = warc.write_archives(spark.createDataFrame(rows, PAGE).repartition(3), f"file://{tmp_path}", min_bytes=least)
    kept = {}
    for i, _, h in rows:
        h = h or ""
        if i is not None and len(h.encode()) >= least:
            kept[h] = max(kept.get(h, -1), i)
    expected = []
    for i, u, h in rows:
        data = (h or "").encode()
        refers = kept.get(h or "") if i is not None and len(data) >= least else None
        refers = None if refers == i else refers
        expected.append((str(i), u or "", len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers, None if refers is not None else data))
    key = lambda r: tuple(map(str, r))
    got = [(str(r.page_id), r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.read_archives(index).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)
    some = index.where(F.col("page_id").isin(3, 150, 299))
    assert {r.page_id for r in warc.fetch(some).collect()} == {3, 150, 299}
    files = list(tmp_path.glob("*.warc.zst"))
    assert len(files) >= 3 and not [f for f in tmp_path.iterdir() if f not in files]
    assert len({r.bundle for r in index.select("bundle").distinct().collect()}) == len(files)
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(files[0].read_bytes()), read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1") and b"WARC-Target-URI: http://h/0%0D%0A%\r\n" in b"".join(
        zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read_bytes()), read_across_frames=True).read() for f in files)
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGE), f"{shared_dir(spark)}/none")).count() == 0


def test_fetch_by_record_identifier(spark, tmp_path):
    """Rows of one page id with other html, and of none, are records of their own."""
    rows = [(7, "a", "first"), (7, "b", "second"), (7, "c", None), (9, "d", "first"), (None, "e", "second"), (None, "f", "third")]
    index = warc.write_archives(spark.createDataFrame(rows, PAGE), f"file://{tmp_path}")
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    names = {r.record_id for r in index.collect()}
    assert names == {f"urn:page:{'null' if i is None else i}:{digest(h or '')}" for i, _, h in rows}
    got = {}
    for name in names:
        (r,) = warc.fetch(index.where(F.col("record_id") == name)).collect()
        assert r.record_id == name
        got[r.page_id, r.url] = (r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))
    assert got == {
        (7, "a"): ("revisit", 9, None), (7, "b"): ("response", None, b"second"), (7, "c"): ("response", None, b""), (9, "d"): ("response", None, b"first"),
        (None, "e"): ("revisit", 7, None), (None, "f"): ("response", None, b"third"),
    }


HTML = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<div id="wrap1"><article class="post post-17"><header><h1>Head &amp; line</h1><p>by someone</p></header><p>One   <b>two<br>three</b>&nbsp;four</p><p>Five<p>Six &#233; &lt;x&gt;
<ul><li>a<li>b</ul><div class="ad">Buy</div><form><p>Subscribe</p></form><table><tr><td>c<td>d</table></article>
<div class="comments"><p>A reader comment that is quite long, longer than all else on this page, and it goes on and on and on and on and on.</p></div></div>
<aside>More</aside><footer>&copy; x</footer></body></html>"""


def test_main_text_of_a_page(spark):
    rows = [(i, f"http://h/{i}", HTML) for i in range(3)] + [(9, None, None), (9, None, ""), (10, "http://h/x", "<p>lone &am</p>"), (11, "http://k/", "text only"), (12, "http://h/9", "<b" * 5)]
    pages = spark.createDataFrame(rows, PAGE).withColumn("text", F.lit("old")).withColumn("_winner_", F.lit(1))
    got = html_extract.extract(pages).select("page_id", "text", "n_chars").collect()
    texts = [r.text for r in got]
    assert texts[0] == "Head & line\nOne two three four\nFive\nSix é <x>\na\nb\nc\nd"
    assert texts[0] == texts[1] == texts[2]
    assert texts[3:7] == ["", "", "lone &am", "text only"]
    assert [r.n_chars for r in got] == [len(t) for t in texts]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_host_consensus_overrules_a_page(spark):
    usual = "<body><div class='main'><p>" + "story " * 50 + "</p></div><div class='extra'><p>x</p></div></body>"
    odd = "<body><div class='main'><p>" + "short " * 20 + "</p></div><div class='extra'><p>" + "long tail " * 50 + "</p></div></body>"
    other = odd.replace("short " * 20, "x")  # next to nothing stands at the winning path
    pages = spark.createDataFrame([(1, "http://h/", usual), (2, "http://h/", usual.replace("story", "tale")), (3, "http://h/", odd), (4, "http://h/", other), (5, "http://h/", usual)], PAGE)
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got[3] == ("short " * 20).strip() and got[1].startswith("story") and got[4] == ("long tail " * 50).strip()


TALE = "A whole paragraph of the article stands here, and another sentence follows it."


@pytest.mark.parametrize("name", ["related", "widget", "header", "modal", "social", "notice", "alert", "promo", "ads", "comments", "post related", "ad-box", "comments-area"])
def test_a_wrapper_of_a_noise_name_keeps_its_page(name):
    for inner in (f"<p>{TALE}</p><p>more</p>", f"<article><p>{TALE}</p><p>more</p></article>"):
        page = html_extract.read(f"<body><h1>T</h1><nav><a href='/'>home</a></nav><div class='{name}'>{inner}</div><footer>f</footer></body>")
        assert page.text().endswith(f"{TALE}\nmore")
    parts = html_extract.read("<body>" + f"<div class='{name}'><p>{TALE}</p></div>" * 4 + "<div class='sidebar'><a href='/x'>links</a></div></body>")
    assert parts.text() == "\n".join([TALE] * 4)


@pytest.mark.parametrize("name", ["notice-board", "ad-hoc", "header-text", "social-science", "alert-level", "share-price", "related-work", "login-form-tutorial", "menus"])
def test_a_paragraph_of_an_article_stays_whatever_its_name(name):
    other = "" if name == "menus" else "<p>short</p>"
    page = html_extract.read(f"<body><article><h1>T</h1>{other}<div class='{name}'><p>{TALE}</p></div></article></body>")
    assert page.text() == "\n".join(["T", *["short"] * bool(other), TALE])


@pytest.mark.parametrize("noise", [
    "<div class='ad'>buy this</div>", "<div class='related'><a href='/1'>one more story</a> <a href='/2'>and another</a></div>", "<div class='social-share'><a href='/s'>tweet</a></div>", "<ul class='menu'><li><a href='/'>x</a></li></ul>",
    "<div class='comments'>" + "<p>I think that this reader's comment is long.</p>" * 9 + "</div>", "<div id='comment-list'>" + "<p>first!</p>" * 40 + "</div>", "<form><p>name</p><textarea>x</textarea></form>", "<div class='newsletter'>join us</div>",
    "<div hidden>" + "hidden " * 90 + "</div>", "<div class='cookie-bar'><p>we use cookies</p></div>", "<aside>aside</aside>",
])
def test_boilerplate_of_these_names_still_goes(noise):
    plain = f"<p>{TALE}</p><p>{TALE}</p>"
    outside = html_extract.read(f"<body><div class='text'>{plain}</div>{noise}</body>")
    assert outside.text() == f"{TALE}\n{TALE}"
    assert html_extract.read(f"<body><article>{plain}</article>{noise}</body>").text() == f"{TALE}\n{TALE}"
    if "cookie" not in noise:
        assert html_extract.read(f"<body><article>{plain}{noise}</article></body>").text() == f"{TALE}\n{TALE}"


def test_suspects_inside_a_kept_wrapper_are_judged_too():
    page = html_extract.read(f"<form><div class='widget'><div class='body'><p>{TALE}</p><p>{TALE}</p></div><div class='comments'><p>{TALE}</p></div><div class='ad'>buy</div></div></form>")
    assert page.text() == f"{TALE}\n{TALE}"


@pytest.mark.parametrize("name", ["content no-sidebar", "post comments-open", "entry with-social", "story related-work"])
def test_class_names_that_only_sound_like_noise(name):
    page = html_extract.read(f"<body><nav><a href='/'>home</a></nav><div class='{name}'><p>some text here</p><p>more</p></div><div class='sidebar'>side</div></body>")
    assert page.text() == "some text here\nmore"


@pytest.mark.parametrize("html, text", [
    ("<article><h1>T</h1><p>intro</p><div class='body'><p>" + "x" * 500 + "</p></div></article>", "T\nintro\n" + "x" * 500),
    ("<div class='s'><h1>T</h1><p>intro</p><div class='body'><p>" + "x" * 500 + "</p></div></div><div>else</div>", "T\nintro\n" + "x" * 500),
    ("<a href='x'>only a link</a>", "only a link"),
    ("<p>a <button>b</button> c <math><mi>x</mi></math> <object>d</object><iframe>no</iframe></p>", "a c x d"),
    ("<form><div class='elementor-widget'><p>a page in a form</p></div></form>", "a page in a form"),
    ("<article class='comment'>no</article><article><h1>k</h1>yes <b>it</b><p class='ad'>ad</p></article><div class='ad-box'>" + "long " * 50 + "</div>", "k\nyes it"),
    ("<body><article>k</article><div class='comments'><article class='comment-1 comment'>no " + "no " * 50 + "</article></div>", "k"),
    ("<p>wo<!-- c -->rd<script>x</script> a&nbsp;&#233;&amp;lt;</p>tail < 3 <", "word a é&lt;\ntail < 3 <"),
])
def test_main_text_of_small_pages(html, text):
    page = html_extract.read(html)
    assert page.text() == text


@pytest.mark.parametrize("part", [
    "<a ", "<div><h2>", "<div>", "</div>", "<", "<!--", '<a ="', "<a ='>\"<b=\">'", "<script>", "<p>a", "&amp", '<a "', '<div class="ad-x">a', "<h2>a", "<li><ul><li>a", "<a href=x>a", "<table><tr><td>",
])
def test_hostile_pages_take_linear_time(part):
    """A page of a megabyte in seconds, whatever it repeats."""
    page = part * (1_000_000 // len(part))
    began = time.process_time()
    read = html_extract.read(page)
    read.text(read.path(read.best()))
    assert time.process_time() - began < 20


def test_deep_and_very_long_pages(spark):
    deep = "<div><h2>a</h2>" * 5000 + "end" + "</div>" * 5000
    long = "<article>" + "<p>word &amp; word</p>" * 50_000 + "</article>"
    pages = spark.createDataFrame([(1, "http://h/", deep), (2, "http://k/", long), (3, "http://h/", "<a " * 300_000)], PAGE).withColumn("_host", F.lit("own")).withColumn("winner", F.lit("own"))
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert got[1].text == "\n".join(["a"] * 5000 + ["end"]) and got[2].text == "\n".join(["word & word"] * 50_000)
    assert got[1]._host == "own" and got[3].winner == "own"


class _Slow(HTMLParser):
    """The given pages' articles by another parser: blocks within article, outside what is skipped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skipped, self.blocks, self.now = 0, 0, [], ""

    def cut(self):
        if text := " ".join(self.now.split()):
            self.blocks.append(text)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        noisy = tag in ("nav", "footer", "aside", "form", "script", "style", "head") or dict(attrs).get("class") == "ad"
        if tag == "br":
            self.now += " "
        elif tag in ("p", "h1", "article", "ul", "li", "div"):
            self.cut()
        self.inside += tag == "article"
        self.skipped += noisy

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article", "ul", "li", "div"):
            self.cut()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.now += data


def test_given_pages_against_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = html_extract.op10_main_text(spark, "/root/testdata/sf0.01").collect()
    want = {}
    for r in pages.collect():
        parser = _Slow()
        parser.feed(r.html or "")
        parser.close()
        parser.cut()
        want.setdefault(r.page_id, []).append("\n".join(parser.blocks))
    assert len(got) == sum(map(len, want.values()))
    assert all(r.text in want[r.page_id] and r.n_chars == len(r.text) for r in got)


def test_warc_of_a_very_large_payload(spark, tmp_path):
    large = "payload é\r\n\r\n" * 400_000
    rows = [(1, "http://h/%41", large), (2, "http://h/%41", large), (3, None, "x")]
    index = warc.write_archives(spark.createDataFrame(rows, PAGE).withColumn("sha", F.lit("own")).withColumn("p", F.lit(1)), f"file://{tmp_path}")
    got = {r.page_id: r for r in warc.read_archives(index).collect()}
    assert bytes(got[2].payload).decode() == large and got[1].refers_to == 2 and got[1].payload is None and got[1].url == "http://h/%41"
