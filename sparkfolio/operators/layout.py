"""Layout geometry: reading order, locating blocks in text, question regions and the placement of figures.

Blocks are rows (doc_id, page_index, x0, y0, x1, y1, order, text, image_ref). Boxes are doubles; results are rounded half-even to
6 places. A question's or a page's blocks are the largest group that meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import inf

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sparkfolio.functions import patterns as P
from sparkfolio.functions.text import let, strip, text
from sparkfolio.operators.components import ACROSS, GAP, components_of, touching_groups
from sparkfolio.operators.intervals import NARROW, overlaps
from sparkfolio.operators.jobs import given

PADDING, AUTO_AT, MANUAL = 0.006, 0.95, ("confirmed", "overridden")


def reading_order(items: DataFrame) -> DataFrame:
    """``order`` by page, top, left and the order before."""
    w = Window.partitionBy("doc_id").orderBy("page_index", "y0", "x0", "order")
    return items.withColumn("order", F.row_number().over(w) - 1)


def expand_lines(items: DataFrame) -> DataFrame:
    """Blocks of several lines as one box a line, of equal height."""
    rows = items.withColumn("_l", F.split(text(F.col("text")), "\n", -1))
    rows = rows.select("*", F.posexplode("_l").alias("line", "_t")).withColumn("_h", (F.col("y1") - F.col("y0")) / F.size("_l"))
    top = F.col("y0") + F.col("line") * F.col("_h")
    return rows.withColumn("text", F.col("_t")).withColumn("y1", top + F.col("_h")).withColumn("y0", top).drop("_l", "_t", "_h")


def locate_in_text(items: DataFrame, docs: DataFrame, prefix: int = 24) -> DataFrame:
    """(doc_id, order, start): where each block's text (its first 24 characters if longer, or its image reference) stands, from behind the one before."""
    needle = F.when(given(F.col("image_ref")), F.col("image_ref")).otherwise(F.substring(strip(text(F.col("text"))), 1, prefix))
    rows = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("order", needle.alias("needle")))).alias("b")).join(docs.select("doc_id", text(F.col("markdown")).alias("_md")), "doc_id")
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<order:int,start:int>>").alias("out"))

    def fold(s, b):
        at = F.call_function("locate", b["needle"], F.col("_md"), s["at"])
        hit = (F.length(b["needle"]) > 0) & (at > 0)
        row = F.struct(b["order"].cast("int").alias("order"), F.when(hit, at - 1).cast("int").alias("start"))
        return F.struct(F.when(hit, at + F.length(b["needle"])).otherwise(s["at"]).alias("at"), F.concat(s["out"], F.array(row)).alias("out"))

    return rows.select("doc_id", F.inline(F.aggregate("b", zero, fold, lambda s: s["out"])))


def anchor_groups(items: DataFrame) -> DataFrame:
    """Blocks with the question group they are in: a numbered block opens one; groups of prefaces and blocks before the first go. ``confidence`` 0.94 (0.96: the anchor alone)."""
    number = F.nullif(F.regexp_extract(strip(text(F.col("text"))), P.QUESTION_NUMBER, 1), F.lit("")).cast("int")
    w = Window.partitionBy("doc_id").orderBy("order")
    rows = items.withColumn("number", number).withColumn("group", F.sum(number.isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("group") > 0)
    g = Window.partitionBy("doc_id", "group")
    rows = rows.withColumn("_preface", F.bool_or(F.col("number").isNotNull() & text(F.col("text")).rlike(P.PREFACE)).over(g)).where(~F.col("_preface"))
    return rows.withColumn("number", F.max("number").over(g)).withColumn("confidence", F.when(F.count(F.lit(1)).over(g) == 1, 0.96).otherwise(0.94)).drop("_preface")


def align_sequences(questions: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, question, group): question numbers laid on group numbers from the start with the longest common prefix; ties: no preface, then first.

    questions: (doc_id, position, number); groups: (doc_id, group, number, preface). From there greedily forward: a group of another,
    smaller number is passed over; a larger one stops.
    """
    q = questions.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "number"))), lambda x: x["number"].cast("int")).alias("q"))
    g = groups.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("group", F.col("number").cast("int").alias("number"), "preface"))).alias("g"))
    rows = q.join(g, "doc_id")
    starts = F.sequence(F.lit(0), F.size("g") - 1)

    def run(i):
        return F.aggregate(F.sequence(F.lit(0), F.size("q") - 1), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, k: F.struct(
            (s["n"] + F.when(s["on"] & F.coalesce(F.get("q", k) == F.get("g", i + k)["number"], F.lit(False)), 1).otherwise(0)).alias("n"), (s["on"] & F.coalesce(F.get("q", k) == F.get("g", i + k)["number"], F.lit(False))).alias("on")), lambda s: s["n"])

    best = F.array_max(F.transform(starts, lambda i: F.struct(run(i).alias("n"), (~F.get("g", i)["preface"]).alias("clean"), (-i).alias("back"))))
    rows = rows.withColumn("at", -best["back"])
    zero = F.struct(F.lit(0).alias("k"), F.lit(False).alias("stop"), F.array().cast("array<struct<question:int,group:bigint>>").alias("out"))

    def step(s, x):
        wanted = F.get("q", s["k"])
        same, larger = F.coalesce(x["number"] == wanted, F.lit(False)), F.coalesce(x["number"] > wanted, F.lit(True))
        hit = ~s["stop"] & same
        return F.struct((s["k"] + hit.cast("int")).alias("k"), (s["stop"] | (~same & larger)).alias("stop"), F.when(hit, F.concat(s["out"], F.array(F.struct(s["k"].alias("question"), x["group"].cast("bigint").alias("group"))))).otherwise(s["out"]).alias("out"))

    return rows.select("doc_id", F.inline(F.aggregate(F.slice("g", F.col("at") + 1, F.size("g")), zero, step, lambda s: s["out"])))


def items_in_span(items: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, question_id, order): blocks whose text overlaps a question's span, and all between the first and last of them. Two interval joins, of positions and of orders."""
    hits = overlaps(items.select("doc_id", "order", "start", "end"), spans.select("doc_id", "question_id", "start", "end"), ["doc_id"])
    reach = hits.groupBy(F.col("r.doc_id").alias("doc_id"), F.col("r.question_id").alias("question_id")).agg(F.min("l.order").alias("low"), (F.max("l.order") + 1).alias("high"))
    places = items.select("doc_id", "order", (F.col("order") + 1).alias("behind"))
    return overlaps(places, reach, ["doc_id"], ("order", "behind"), ("low", "high")).select("r.doc_id", "r.question_id", "l.order")


def region_filter(groups: DataFrame, least_area: float = 0.0005) -> DataFrame:
    """(doc_id, question_id) whose blocks hold the images expected and cover more than a fragment. groups: block rows with expected_images."""
    area = F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return groups.groupBy("doc_id", "question_id").agg(area.alias("area"), F.count_if(given(F.col("image_ref"))).alias("images"), F.max("expected_images").alias("expected")).where((F.col("images") >= F.col("expected")) & (F.col("area") >= least_area)).select("doc_id", "question_id")


def question_regions(items: DataFrame) -> DataFrame:
    """(question_id, page_index, x, y, w, h): box around a question's blocks on a page, padded and clamped to the page, as shares of it (page_width, page_height)."""
    share = lambda c, size: F.col(c) / F.col(size)
    box = items.groupBy("question_id", "page_index").agg(
        F.min(share("x0", "page_width")).alias("a"), F.min(share("y0", "page_height")).alias("b"), F.max(share("x1", "page_width")).alias("c"), F.max(share("y1", "page_height")).alias("d"))
    low = lambda c: F.greatest(F.col(c) - PADDING, F.lit(0.0))
    high = lambda c: F.least(F.col(c) + PADDING, F.lit(1.0))
    return box.select("question_id", "page_index", F.bround(low("a"), 6).alias("x"), F.bround(low("b"), 6).alias("y"), F.bround(high("c") - low("a"), 6).alias("w"), F.bround(high("d") - low("b"), 6).alias("h"))


def union_regions(regions: DataFrame, small: int = 64) -> DataFrame:
    """Regions of a question and page united where they touch: x-overlap of a quarter of the narrower, and y-overlap or a gap of at most 0.02.

    regions: (region_id, question_id, page_index, x, y, w, h, confidence), without nulls. Confidence is the least; ``sources`` keeps the ids. Pages of at most ``small`` regions are compared in
    pairs; the others by a search over cells, a page at a time.
    """
    keys = ["question_id", "page_index"]
    rows = [c for c in regions.columns if c not in keys]
    crowded = regions.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > small).select(*keys, F.lit(True).alias("_crowded"))
    crowded = crowded if crowded.limit(NARROW + 1).count() > NARROW else F.broadcast(crowded)  # mostly few or none: regions aren't shuffled for them
    marked = regions.join(crowded, keys, "left")
    few, many = marked.where(F.col("_crowded").isNull()).drop("_crowded"), marked.where("_crowded").drop("_crowded")
    pages = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("region_id", *[c for c in rows if c != "region_id"]))).alias("_r"))

    def near(a, b):
        across = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
        gap = F.greatest(a["y"], b["y"]) - F.least(a["y"] + a["h"], b["y"] + b["h"])
        return (across >= ACROSS * F.least(a["w"], b["w"])) & (gap <= GAP)

    pairs = F.flatten(F.transform("_r", lambda a: F.transform(F.filter("_r", lambda b: (a["region_id"] < b["region_id"]) & near(a, b)), lambda b: F.struct(a["region_id"].alias("u"), b["region_id"].alias("v")))))
    rows = pages.withColumn("_c", components_of(pairs, F.transform("_r", lambda a: a["region_id"]))).select(*keys, F.inline(F.arrays_zip(F.col("_r").alias("_r"), F.col("_c").alias("component")))).select(*keys, "_r.*", "component").select(*regions.columns, "component")

    def searched(page: pa.Table) -> pa.Table:
        page = page.sort_by("region_id")
        group = touching_groups(*(page.column(c).to_numpy().astype(float) for c in ("x", "y", "w", "h")))
        return page.append_column("component", page.column("region_id").take(pa.array(group)))

    found = many.groupBy(*keys).applyInArrow(searched, StructType([*regions.schema.fields, StructField("component", regions.schema["region_id"].dataType)]))
    rows = rows.unionByName(found)
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return rows.groupBy("question_id", "page_index", "component").agg(
        F.bround(F.min("x"), 6).alias("x"), F.bround(F.min("y"), 6).alias("y"), F.bround(right - F.min("x"), 6).alias("w"), F.bround(bottom - F.min("y"), 6).alias("h"), F.min("confidence").alias("confidence"), F.sort_array(F.collect_list("region_id")).alias("sources"))


def place_images_by_offset(images: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, image_id, kind, target_id, confidence, auto): the first option that holds an image's position, else part, else stem, else unassigned.

    images: (doc_id, image_id, start, has_box); spans: (doc_id, kind, target_id, start, end).
    """
    rank = F.when(F.col("r.kind") == "option", 0).when(F.col("r.kind") == "part", 1).otherwise(2)
    target = F.when(F.col("r.kind").isNotNull(), F.struct(rank.alias("k"), F.col("r.start").alias("at"), F.col("r.target_id").alias("target_id"), F.col("r.kind").alias("kind")))
    points = images.select("doc_id", "image_id", "has_box", "start", (F.col("start") + 1).alias("end"))
    held = overlaps(points, spans.select("doc_id", "kind", "target_id", "start", "end"), ["doc_id"]).select("l.doc_id", "l.image_id", "l.has_box", target.alias("t"))
    every = held.unionByName(images.select("doc_id", "image_id", "has_box"), allowMissingColumns=True)
    best = every.groupBy("doc_id", "image_id", "has_box").agg(F.min("t").alias("t"))
    confidence = F.when(F.col("t").isNull(), 0.0).when(F.col("has_box"), 0.96).otherwise(0.9)
    return best.select("doc_id", "image_id", F.coalesce("t.kind", F.lit("unassigned")).alias("kind"), F.col("t.target_id").alias("target_id"), confidence.alias("confidence"), (confidence >= AUTO_AT).alias("auto"))


def option_labels(items: DataFrame, expected: int = 4) -> DataFrame:
    """(question_id, label, x0, y0, x1, y1, synthetic): label blocks, the first of each; the first missing expected label is made from a block whose text ends with it (its last 18 % of width, 10 to 18 wide)."""
    t = strip(text(F.col("text")))
    label = F.nullif(F.regexp_extract(t, r"^[（(]?([A-H])[.．、)）]?$", 1), F.lit(""))
    first = F.row_number().over(Window.partitionBy("question_id", "label").orderBy("order"))
    own = items.withColumn("label", label).where(F.col("label").isNotNull()).withColumn("k", first).where("k = 1").select("question_id", "label", "x0", "y0", "x1", "y1", F.lit(False).alias("synthetic"))
    have = own.groupBy("question_id").agg(F.collect_set("label").alias("have"))
    wanted = F.array(*[F.lit(chr(65 + i)) for i in range(expected)])
    missing = have.withColumn("label", F.get(F.array_except(wanted, F.col("have")), F.lit(0))).where(F.col("label").isNotNull()).select("question_id", "label")
    ends = items.withColumn("own", label).where(F.col("own").isNull()).join(missing, "question_id").where(t.endswith(F.concat(F.lit(" "), F.col("label"))) | t.endswith(F.concat(F.lit("　"), F.col("label"))))
    width = F.least(F.greatest((F.col("x1") - F.col("x0")) * 0.18, F.lit(10.0)), F.lit(18.0))
    made = ends.withColumn("k", F.row_number().over(Window.partitionBy("question_id").orderBy("order"))).where("k = 1").select("question_id", "label", (F.col("x1") - width).alias("x0"), "y0", "x1", "y1", F.lit(True).alias("synthetic"))
    return own.unionByName(made)


def assignment_costs(labels: DataFrame, images: DataFrame) -> DataFrame:
    """(question_id, label, image_id, cost): 1.4 dx + 2 dy of the centres, less 0.08 with x-overlap, at least 0; other pages 5 plus their distance.

    labels: (question_id, label, page_index, x0..y1), images likewise with image_id; boxes as shares of the page.
    """
    l, i = labels.alias("l"), images.alias("i")
    centre = lambda s, a: (F.col(f"{s}.{a}0") + F.col(f"{s}.{a}1")) / 2
    over = F.least("l.x1", "i.x1") > F.greatest("l.x0", "i.x0")
    near = F.greatest(1.4 * F.abs(centre("l", "x") - centre("i", "x")) + 2 * F.abs(centre("l", "y") - centre("i", "y")) - F.when(over, 0.08).otherwise(0.0), F.lit(0.0))
    pages = F.abs(F.col("l.page_index") - F.col("i.page_index"))
    return l.join(i, F.col("l.question_id") == F.col("i.question_id")).select("l.question_id", "l.label", "i.image_id", F.bround(F.when(pages > 0, 5.0 + pages).otherwise(near), 9).alias("cost"))


def _cheapest(costs: list[list[float]]) -> tuple[float, list[int]]:
    """The Hungarian method: least total of one column for each row, no column twice; rows must not outnumber columns. Infinite costs are forbidden."""
    n, m = len(costs), len(costs[0])
    big = 1 + 2 * sum(max((x for x in r if x < inf), default=0.0) for r in costs)
    c = [[x if x < inf else big for x in r] for r in costs]
    u, v, row, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row[0], at, least, seen = i, 0, [inf] * (m + 1), [False] * (m + 1)
        while row[at]:
            seen[at] = True
            delta, following = inf, 0
            for j in range(1, m + 1):
                if not seen[j]:
                    reduced = c[row[at] - 1][j - 1] - u[row[at]] - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, at
                    if least[j] < delta:
                        delta, following = least[j], j
            for j in range(m + 1):
                if seen[j]:
                    u[row[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            at = following
        while at:
            row[at] = row[way[at]]
            at = way[at]
    chosen = [0] * n
    for j in range(1, m + 1):
        if row[j]:
            chosen[row[j] - 1] = j - 1
    return round(sum(costs[i][j] for i, j in enumerate(chosen)), 9), chosen


def _two_cheapest(costs: list[list[float]]) -> tuple[float, list[int], float | None]:
    """The least total, the first assignment in order of columns that has it, and the second least total (None if there is no other)."""
    best, chosen = _cheapest(costs)
    fixed = [list(r) for r in costs]
    for i, r in enumerate(costs):  # ties go to the least column, row by row
        for j in range(chosen[i] + 1):
            tried = [[x if k == j else inf for k, x in enumerate(r)] if n == i else q for n, q in enumerate(fixed)]
            total, other = _cheapest(tried)
            if total == best:
                fixed, chosen = tried, other
                break
    others = [_cheapest([[inf if (n, k) == (i, j) else x for k, x in enumerate(q)] for n, q in enumerate(costs)])[0] for i, j in enumerate(chosen)]
    second = min(others)
    return best, chosen, second if second < inf else None


def _assign(question, costs) -> list[tuple]:
    """The cheapest one-to-one assignment of a question's images to labels and its margin to the second; none where images outnumber labels."""
    known = {(c["label"], c["image_id"]): c["cost"] for c in costs}
    labels, images = sorted({a for a, _ in known if a is not None}), sorted({b for _, b in known})
    if len(images) > len(labels):
        return [(question, None, b, None, True, 0.0, "option_image_one_to_one_violation") for b in images]
    total, chosen, second = _two_cheapest([[known[a, b] for a in labels] for b in images])
    margin = None if second is None else second - total
    unsure = margin is None or margin < 0.015
    confidence = 0.84 if unsure else min(0.98, 0.92 + 2 * margin)
    return [(question, labels[k], b, total, unsure, round(confidence, 6), None) for k, b in zip(chosen, images, strict=True)]


def assign_images(labels: DataFrame, images: DataFrame) -> DataFrame:
    """(question_id, label, image_id, total, ambiguous, confidence, reason). Costs are a join; only the search per question is Python, over batches of questions.

    Where a question's images outnumber its labels none is assigned: label and total are null, and the reason says so.
    """
    costs = assignment_costs(labels, images)
    kinds = dict(costs.dtypes)
    bare = images.join(labels.select("question_id").distinct(), "question_id", "left_anti")
    costs = costs.unionByName(bare.select("question_id", F.lit(None).cast("string").alias("label"), "image_id", F.lit(None).cast("double").alias("cost")))
    whole = costs.groupBy("question_id").agg(F.collect_list(F.struct("label", "image_id", "cost")).alias("costs"))
    columns = ["question_id", "label", "image_id", "total", "ambiguous", "confidence", "reason"]

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [r for q, c in zip(part["question_id"], part["costs"], strict=True) for r in _assign(q, c)]
            yield pd.DataFrame(rows, columns=columns).astype({"total": "Float64"})

    return whole.mapInPandas(assigned, f"question_id {kinds['question_id']}, label string, image_id {kinds['image_id']}, total double, ambiguous boolean, confidence double, reason string")


def reconcile_placements(placements: DataFrame, assignment: DataFrame) -> DataFrame:
    """Placements (image_id, target, status, confidence) with the assignment (image_id, label, confidence): confirmed and overridden ones stay and note the
    alternative; unassigned ones adopt; agreement raises confidence; a conflict replaces and keeps the old target as alternative. Adds outcome and alternative."""
    a = assignment.select("image_id", F.col("label").alias("_label"), F.col("confidence").alias("_c"))
    j = placements.join(a, "image_id", "left")
    none, manual, same = F.col("_label").isNull(), F.col("status").isin(*MANUAL), F.col("target") == F.col("_label")
    free = ~given(F.col("target"))
    outcome = F.when(none, "kept").when(manual & same, "kept").when(manual, "protected").when(free, "adopted").when(same, "agreed").otherwise("replaced")
    j = j.withColumn("outcome", outcome)
    alternative = F.when(F.col("outcome") == "protected", F.col("_label")).when(F.col("outcome") == "replaced", F.col("target"))
    takes = F.col("outcome").isin("adopted", "replaced")
    return j.select("image_id", F.when(takes, F.col("_label")).otherwise(F.col("target")).alias("target"), "status", F.when(takes, F.col("_c")).when(F.col("outcome") == "agreed", F.greatest("confidence", "_c")).otherwise(F.col("confidence")).alias("confidence"), "outcome", alternative.alias("alternative"))


def match_image_paths(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id): rows of the same normalised path if it is unique, else of a path ending in it (either way) if that is.

    Each side's paths, and the ends of longer ones, are counted before they meet, so a name that all documents share makes no pairs.
    """
    norm = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(text(F.col(c)), r"[?#].*$", ""), r"\\", "/"), r"^[./]+", ""))
    ends = lambda c: F.explode(let(F.split(F.col(c), "/"), lambda p: F.transform(F.sequence(F.lit(2), F.greatest(F.size(p), F.lit(2))), lambda k: F.when(k <= F.size(p), F.array_join(F.slice(p, k, F.size(p)), "/")))))
    l = left.select(F.col("id").alias("left_id"), norm("path").alias("lp")).where(~F.col("lp").endswith("/") & (F.col("lp") != ""))
    r = right.select(F.col("id").alias("right_id"), norm("path").alias("rp"))
    tally = lambda df, c, n, least: df.groupBy(c).agg(F.count(F.lit(1)).alias(n), F.min("right_id").alias(least))
    same = tally(r, "rp", "e", "er")
    inner = tally(r.select("right_id", ends("rp").alias("end")).where("end IS NOT NULL"), "end", "i", "ir")
    outer = l.select("left_id", ends("lp").alias("rp")).where("rp IS NOT NULL").join(same, "rp").groupBy("left_id").agg(F.sum("e").alias("o"), F.min("er").alias("orr"))
    met = l.join(same, F.col("lp") == F.col("rp"), "left").join(inner, F.col("lp") == F.col("end"), "left").join(outer, "left_id", "left")
    others = F.coalesce("i", F.lit(0)) + F.coalesce("o", F.lit(0))
    chosen = F.when(F.col("e") == 1, F.col("er")).when(F.col("e").isNull() & (others == 1), F.coalesce("ir", "orr"))
    return met.select("left_id", chosen.alias("right_id")).where("right_id IS NOT NULL")


def validate_placements(images: DataFrame, placements: DataFrame) -> DataFrame:
    """(question_id, codes): what blocks a question: images without placement or the reverse, several placements of an image, no box, some options
    with and some without image, the same image on stem and option, unresolved manual conflicts.

    images: (question_id, image_id); placements: (question_id, image_id, kind, label, has_box, conflict), option_count per question on it.
    """
    i = images.select("question_id", "image_id", F.lit(1).alias("known"))
    per = placements.groupBy("question_id", "image_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("kind").alias("kinds"))
    j = i.join(per, ["question_id", "image_id"], "full_outer").groupBy("question_id").agg(
        F.count_if(F.col("known").isNull() | F.col("n").isNull()).alias("lost"), F.count_if(F.col("n") > 1).alias("several"), F.count_if(F.col("kinds") > 1).alias("both"))
    p = placements.groupBy("question_id").agg(F.count_if(~F.col("has_box")).alias("bare"), F.countDistinct(F.when(F.col("kind") == "option", F.col("label"))).alias("labels"), F.max("option_count").alias("options"), F.count_if("conflict").alias("conflicts"))
    part = (F.col("labels") > 0) & (F.col("labels") < F.col("options"))
    codes = F.array_compact(F.array(
        F.when(F.col("lost") > 0, "conservation"), F.when(F.col("several") > 0, "one-to-one"), F.when(F.col("bare") > 0, "missing-geometry"), F.when(part, "incomplete-options"), F.when(F.col("both") > 0, "stem-option-conflict"), F.when(F.col("conflicts") > 0, "manual-conflict")))
    return j.join(p, "question_id", "left").select("question_id", codes.alias("codes"))


def trusted_option_refs(placements: DataFrame) -> DataFrame:
    """(question_id, label, images): option content from placements that are confirmed, overridden, or sure without needing review; an image claimed more than once is left out."""
    sure = F.col("status").isin(*MANUAL) | ((F.col("status") != "needs_review") & (F.col("confidence") >= AUTO_AT))
    once = F.count(F.lit(1)).over(Window.partitionBy("question_id", "image_id"))
    rows = placements.where(F.col("kind") == "option").withColumn("n", once).where(sure & (F.col("n") == 1))
    return rows.groupBy("question_id", "label").agg(F.sort_array(F.collect_list("image_id")).alias("images"))


def accept_external_assignment(candidates: DataFrame, mapping: DataFrame) -> DataFrame:
    """(question_id, accepted): a supplied mapping (question_id, image_id, label) counts if the question is eligible (0.8 <= confidence < 0.95 or a conflict), it covers exactly
    the candidate images (question_id, image_id, confidence, conflict, labels), uses allowed labels and none twice."""
    c = candidates.groupBy("question_id").agg(F.sort_array(F.collect_set("image_id")).alias("want"), F.bool_or(((F.col("confidence") >= 0.8) & (F.col("confidence") < AUTO_AT)) | F.col("conflict")).alias("eligible"), F.first("labels").alias("allowed"))
    m = mapping.groupBy("question_id").agg(F.sort_array(F.collect_list("image_id")).alias("got"), F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("d"), F.collect_set("label").alias("used"))
    fine = F.col("eligible") & (F.col("want") == F.col("got")) & (F.col("n") == F.col("d")) & (F.size(F.array_except("used", "allowed")) == 0)
    return c.join(m, "question_id", "left").select("question_id", F.coalesce(fine, F.lit(False)).alias("accepted"))


def locate_question_block(questions: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, question_id, order): the first block that has the question's number, else the first that holds the first 24 characters of its stem."""
    number = F.nullif(F.regexp_extract(strip(text(F.col("text"))), P.QUESTION_NUMBER, 1), F.lit("")).cast("int")
    squeeze = lambda c: F.regexp_replace(text(c), r"(?U)\s+", "")
    by_number = items.withColumn("number", number).where("number IS NOT NULL").groupBy("doc_id", "number").agg(F.min("order").alias("n_order"))
    q = questions.select("doc_id", "question_id", "number", F.substring(squeeze(F.col("stem")), 1, 24).alias("head")).join(by_number, ["doc_id", "number"], "left")
    rest = q.where(F.col("n_order").isNull() & (F.col("head") != ""))
    t = items.select(F.col("doc_id").alias("d"), F.col("order").alias("o"), squeeze(F.col("text")).alias("t"))
    found = rest.join(t, (F.col("doc_id") == F.col("d")) & F.col("t").contains(F.col("head"))).groupBy("doc_id", "question_id").agg(F.min("o").alias("t_order"))
    return q.join(found, ["doc_id", "question_id"], "left").select("doc_id", "question_id", F.coalesce("n_order", "t_order").alias("order"))

