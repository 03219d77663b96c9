"""URL filters: rules by host and path, then host reputation by empirical Bayes; DataFrame functions only.

Rules. A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the rule's; the longest
host and path win, a block before an allow of the same text.

Reputation. Labelled page outcomes (bad or not) are tallied per host, registered domain and suffix. A level's bad rate is shrunk
through a beta prior around the level above: suffixes to the rate over all, domains to their suffix, hosts to their domain. How
strong the prior is comes from the data: the beta-binomial method of moments over the units of a level, clamped to
``STRENGTH``. A host's posterior is Beta(a, b). A page is blocked if the lower posterior bound of its host's bad rate is above ``LIMIT`` times the
rate over all: the host is worse with a probability of ``SURE`` or more. Whether the bound is above follows from the beta distribution's own series at that
limit. Hosts without labels have their domain's posterior, or that of the suffix, or of all.

The suffix is the host's last label, or the longest of a parameter table of public suffixes (such as ``co.uk``) that the host ends with; the registered domain has one
label more; a host without one is its own domain. Null urls and urls without ``://`` have empty host and path and fit
no rule. Without labels the rate is ``BASE`` everywhere, so nothing is blocked. Outcomes of the same page count once each; null outcomes don't. Repeated pages are judged each.
Very long urls are whole. An empty table gives no rows. Columns host, path, rule, verdict and not_worse are replaced, all others kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import cut, join_small, table

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
#: Rules in a list are held by each task; longer lists are to be a table (host, path, verdict).
MAX_RULES = 1000
STRENGTH, BASE, LIMIT, SURE = (2.0, 200.0), 0.1, 1.0, 0.9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def matched_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (length, block, rule, verdict) of the rule that wins, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules in a list; give them as a DataFrame (host, path, verdict)")
    known = [
        F.when(
            ((host_ == r) | host_.endswith(f".{r}")) & path_.startswith(p),
            F.struct(F.lit(len(r + p)).alias("length"), F.lit(v == "block").alias("block"), F.lit(r + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for r, p, v in rules
    ]
    return F.array_max(F.array(*known)) if known else F.lit(None).cast("struct<length:int,block:boolean,rule:string,verdict:string>")


def table_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, won) of the hosts and paths of ``rows`` that a rule of a table (host, path, verdict) fits; won as ``matched_rule`` has it.

    A host's ends and a path's beginnings, as long as some rule's, meet the rules by equality, so nothing is held against all rules.
    """
    known = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(F.col("host").alias("end"), F.col("path").alias("start"), "verdict")
    known = cut(known.groupBy("end", "start").agg(F.max(F.struct((F.col("verdict") == "block").alias("block"), "verdict")).alias("v")))
    most = known.agg(F.max(F.size(F.split("end", r"\.")))).first()[0] or 1
    lengths = F.array(*[F.lit(r[0]) for r in known.select(F.length("start")).distinct().orderBy(F.length("start")).collect()], F.lit(-1))  # a number for each length that occurs
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    starts = F.transform(F.filter(lengths, lambda n: (n >= 0) & (n <= F.length("path"))), lambda n: F.substring(F.col("path"), F.lit(1), n))
    asked = rows.select("host", "path").distinct().withColumn("end", F.explode(ends)).withColumn("start", F.explode(starts))
    met = join_small(asked, known, ["end", "start"]).where("v IS NOT NULL")
    rule = F.concat("end", "start")
    best = F.max(F.struct(F.length(rule).alias("length"), F.col("v.block").alias("block"), rule.alias("rule"), F.col("v.verdict").alias("verdict")))
    return met.groupBy("host", "path").agg(best.alias("won"))


def levels(host_: Column, size: Column | None = None) -> list[tuple[str, Column]]:
    """Suffix, domain and host; ``size`` is the number of labels in the suffix, null for one."""
    labels = F.split(host_, r"\.")
    n = F.coalesce(size, F.lit(1)) if size is not None else F.lit(1)
    last = lambda k: F.when(F.size(labels) < k, host_).otherwise(F.array_join(F.slice(labels, -k, k), "."))
    return [("suffix", last(n)), ("domain", last(n + 1)), ("host", host_)]


def suffix_sizes(hosts: DataFrame, suffixes: DataFrame | None) -> DataFrame | None:
    """(host, size) of the hosts that end with a suffix of more than one label: the longest."""
    if suffixes is None:
        return None
    listed = suffixes.select(F.lower("suffix").alias("end")).where("end IS NOT NULL").distinct().withColumn("size", F.size(F.split("end", r"\.")))
    most = listed.agg(F.max("size")).first()[0] or 1
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.least(F.size(labels), F.lit(most)).cast("int")), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    long_enough = hosts.select("host").distinct().where((F.size(labels) >= 2) & (F.lit(most) >= 2))
    return long_enough.select("host", F.explode(ends).alias("end")).join(listed, "end").groupBy("host").agg(F.max("size").alias("size"))


def _ln_gamma(z: Column) -> Column:
    """Stirling's series eight steps up; good to about ten digits."""
    y = z + 8
    steps = F.lit(1.0)
    for k in range(8):
        steps = steps * (z + k)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - F.log(steps)


def not_worse(a: Column, b: Column, limit: float) -> Column:
    """The posterior probability that a rate of Beta(a, b) is at most ``limit``, by series; 1 where the mean itself isn't above it."""
    if not 0 < limit < 1:
        return F.lit(1.0)
    n = F.ceil(64 + 12 * F.sqrt(a + b) + 30 / (1 - limit)).cast("int")
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(held: Column, k: Column) -> Column:
        t = held["t"] * limit * (a + b + k - 1) / (a + k)
        return F.struct(t.alias("t"), (held["s"] + t).alias("s"))

    series = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda held: held["s"])
    scale = F.exp(a * math.log(limit) + b * math.log1p(-limit) - F.log(a) - _ln_gamma(a) - _ln_gamma(b) + _ln_gamma(a + b))
    return F.when(a / (a + b) > limit, scale * series).otherwise(F.lit(1.0))


def _strength(units: DataFrame) -> float:
    """a + b of the beta prior over the units (n, bad, mean above), by the method of moments, within STRENGTH.

    With n_i trials, E[(bad_i - n_i m_i)^2] = n_i m_i (1 - m_i) (1 + (n_i - 1) rho) and a + b = 1 / rho - 1.
    """
    spread = F.col("above") * (1 - F.col("above"))
    seen, even, more = units.where(F.col("n") > 1).agg(
        F.sum((F.col("bad") - F.col("n") * F.col("above")) ** 2), F.sum(F.col("n") * spread), F.sum(F.col("n") * (F.col("n") - 1) * spread)
    ).first()
    if not more:
        return STRENGTH[1]
    rho = (seen - even) / more
    return STRENGTH[1] if rho <= 0 else min(max(1 / rho - 1, STRENGTH[0]), STRENGTH[1])


def reputations(outcomes: DataFrame, suffixes: DataFrame | None = None) -> tuple[dict[str, DataFrame], float]:
    """Tables (unit, a, b, not_worse) by level and the rate over all, from rows (host, bad)."""
    tally = cut(outcomes.where(F.col("bad").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")))
    sizes = suffix_sizes(tally, suffixes)
    sized = tally.withColumn("size", F.lit(None).cast("int")) if sizes is None else tally.join(sizes, "host", "left")
    columns = dict(levels(F.col("host"), F.col("size")))
    tally = cut(sized.select("host", columns["domain"].alias("domain"), columns["suffix"].alias("suffix"), "n", "bad"))
    n, bad = tally.agg(F.sum("n"), F.sum("bad")).first()
    rate = bad / n if n else BASE
    tables, above = {}, None
    for level, up in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        units = tally.groupBy(level, *([up] if up else [])).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        if up is None:
            units = units.withColumn("above", F.lit(float(rate)))
        else:
            units = units.join(above.select(up, (F.col("a") / (F.col("a") + F.col("b"))).alias("above")), up)
        units = cut(units)
        k = _strength(units)
        above = cut(units.select(level, (F.col("above") * k + F.col("bad")).alias("a"), ((1 - F.col("above")) * k + F.col("n") - F.col("bad")).alias("b")))
        tables[level] = above.withColumn("not_worse", not_worse(F.col("a"), F.col("b"), LIMIT * rate))
    return tables, rate


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, url_col: str = "url", suffixes: DataFrame | None = None,
) -> DataFrame:
    """``pages`` with host, path, rule, verdict and not_worse, the posterior probability that the host is no worse than the limit."""
    tables, _ = reputations(outcomes, suffixes)
    url = F.col(url_col)
    out = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host(url).alias("host"), path(url).alias("path"))
    sizes = suffix_sizes(out, suffixes)
    out = out.withColumn("size", F.lit(None).cast("int")) if sizes is None else join_small(out, sizes, ["host"])
    for level, column in levels(F.col("host"), F.col("size")):
        side = tables[level].select(F.col(level).alias(f"_{level}"), F.col("not_worse").alias(f"by_{level}"))
        out = join_small(out.withColumn(f"_{level}", column), side, [f"_{level}"])
    known = F.coalesce("by_host", "by_domain", "by_suffix", F.lit(1.0))
    out = out.withColumn("not_worse", known)
    if isinstance(rules, DataFrame):
        out = out.join(table_rules(out, rules), ["host", "path"], "left")
    else:
        out = out.withColumn("won", matched_rule(F.col("host"), F.col("path"), rules))
    by_method = F.when(F.col("not_worse") <= 1 - SURE, F.lit("block")).otherwise(F.lit("allow"))
    made = [F.col("host"), F.col("path"), F.col("won.rule").alias("rule"), F.coalesce(F.col("won.verdict"), by_method).alias("verdict"), F.col("not_worse")]
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "not_worse")]
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *made)


def document_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of labelled pages: the path's number names the document that a page shows; low quality or toxic is bad.

    Pages are counted per host and document before they meet the labels, so a hot host is a few rows.
    """
    marks = labels.groupBy("doc_id").agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")).alias("bad"))
    number = F.regexp_extract(path(F.col("url")), r"^/[a-z]+/(\d{1,18})", 1)
    shown = pages.select(host(F.col("url")).alias("host"), F.try_to_number(F.nullif(number, F.lit("")), F.lit("9" * 18)).cast("long").alias("doc_id"))
    shown = shown.where(F.col("doc_id").isNotNull()).groupBy("host", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    return shown.join(marks, "doc_id").select("host", "bad", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("host", "bad")


def op5_url_filter(spark, sf_dir) -> DataFrame:
    """Host, path, winning rule and verdict of every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge(pages, document_outcomes(pages, table(spark, sf_dir, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    fits = "\n  UNION ALL ".join(
        f"SELECT '{h}' AS h, '{p}' AS p, '{v}' AS v" for h, p, v in RULES
    )
    low, high = STRENGTH

    def level(name: str, up: str) -> str:
        return f"""
{name}_k AS (SELECT CASE WHEN m IS NULL OR m = 0 OR (s - e) / m <= 0 THEN {high} ELSE least(greatest(m / (s - e) - 1, {low}), {high}) END::DOUBLE AS k FROM (
  SELECT sum((bad - n * above) ** 2) AS s, sum(n * above * (1 - above)) AS e, sum(n * (n - 1) * above * (1 - above)) AS m FROM {name}_u WHERE n > 1)),
{name}_r AS (SELECT {name}, above * k + bad AS a, (1 - above) * k + n - bad AS b FROM {name}_u, {name}_k),
{name}_p AS (SELECT {name}, CASE WHEN a / (a + b) > x AND x > 0 AND x < 1 THEN
    exp(a * ln(x) + b * ln(1 - x) - ln(a) - lgamma(a) - lgamma(b) + lgamma(a + b))
    * list_sum(list_transform(range((100 + 15 * sqrt(a + b) + 40 / (1 - x))::INT), lambda i: exp(lgamma(a + b + i) - lgamma(a + b) - lgamma(a + 1 + i) + lgamma(a + 1) + i * ln(x))))
    ELSE 1 END AS p FROM (SELECT *, {LIMIT} * (SELECT rate FROM g) AS x FROM {name}_r))"""

    return rf"""
WITH p AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS raw, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
q AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, path FROM p),
h AS (SELECT *, split_part(host, '.', -1) AS suffix, CASE WHEN len(string_split(host, '.')) < 2 THEN host ELSE split_part(host, '.', -2) || '.' || split_part(host, '.', -1) END AS domain FROM q),
marks AS (SELECT doc_id, max((coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT) AS bad FROM labels GROUP BY doc_id),
o AS (SELECT host, domain, suffix, m.bad FROM h JOIN marks m ON m.doc_id = try_cast(regexp_extract(path, '^/[a-z]+/(\d{{1,18}})', 1) AS BIGINT)),
t AS (SELECT host, domain, suffix, count(*) AS n, sum(bad) AS bad FROM o GROUP BY ALL),
g AS (SELECT coalesce(sum(bad) / sum(n), {BASE})::DOUBLE AS rate FROM t),
suffix_u AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, any_value(rate) AS above FROM t, g GROUP BY suffix),{level("suffix", "")},
domain_u AS (SELECT domain, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, any_value(a / (a + b)) AS above FROM t JOIN suffix_r USING (suffix) GROUP BY domain),{level("domain", "suffix")},
host_u AS (SELECT host, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, any_value(a / (a + b)) AS above FROM t JOIN domain_r USING (domain) GROUP BY host),{level("host", "domain")},
scored AS (
  SELECT h.*, coalesce(hp.p, dp.p, sp.p, 1) AS p FROM h LEFT JOIN host_p hp USING (host) LEFT JOIN domain_p dp USING (domain) LEFT JOIN suffix_p sp USING (suffix)),
rules AS ({fits}),
won AS (
  SELECT page_id, arg_max(r.h || r.p, (len(r.h || r.p), r.v)) AS rule, arg_max(r.v, (len(r.h || r.p), r.v)) AS v
  FROM q JOIN rules r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.p) GROUP BY page_id)
SELECT s.page_id, s.host, s.path, w.rule,
  coalesce(w.v, CASE WHEN p <= 1 - {SURE} THEN 'block' ELSE 'allow' END) AS verdict
FROM scored s LEFT JOIN won w USING (page_id)
"""


ORACLE = _oracle()
