"""Joins of intervals within keys. Small keys meet whole; large ones over bins as wide as the intervals themselves.

A key of at most ``SMALL`` rows on the left is one group: its pairs are at most that many for each row on the right. In larger keys an interval's level is the least
power of ``1 << STEP`` that is as long, so it touches two bins of its level at most. A pair meets at the higher level of its two: there the longer one is at home, and the shorter one,
which touches two bins at most too, visits. Each pair is tested exactly and kept in one bin, that of its later start. So a key of any size is many groups, without a bin width to choose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL, STEP, LEVELS = 256, 3, 14
#: Large keys up to which their list is broadcast.
NARROW = 100_000
#: The one place of all rows of a small key.
_WHOLE = 63


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("start", "end"), small: int = SMALL) -> DataFrame:
    """(l, r): rows of both sides, as structs, with equal keys and l.start < r.end and l.end > r.start.

    Bounds are whole numbers below 2 ** 42; an interval that is null, or ends before it starts, holds nothing. Rows that repeat pair each for itself.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    large = left.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > small).select(*names, F.lit(True).alias("_large"))
    many_large = large.limit(NARROW + 1).count() > NARROW
    large = large if many_large else F.broadcast(large)  # mostly few or none: no side is shuffled for them
    levels = F.array(*[F.lit(STEP * i) for i in range(LEVELS + 1)])

    def placed(df, name, span, visits_own):
        """Rows with a copy for each (level, role, bin) where they meet others; role 0: the right one is at home, role 1: the left one."""
        a, b = (F.col(c).cast("long") for c in span)
        rows = df.select(F.struct("*").alias(name), *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], a.alias("_a"), b.alias("_b")).where("_b >= _a").join(large, names, "left")
        own = F.ceil(F.log2(F.greatest(F.col("_b") - F.col("_a"), F.lit(1))) / STEP).cast("int") * STEP
        visited = F.filter(levels, lambda x: x >= own if visits_own else x > own)
        bins = lambda level, role: F.transform(
            F.sequence(F.call_function("shiftright", "_a", level), F.call_function("shiftright", F.greatest(F.col("_b") - 1, F.col("_a")), level)), lambda x: F.struct(level.alias("on"), F.lit(role).alias("role"), x.alias("bin")))
        many = F.concat(F.flatten(F.transform(visited, lambda x: bins(x, 0 if visits_own else 1))), bins(own, 1 if visits_own else 0))
        one = F.array(F.struct(F.lit(_WHOLE).alias("on"), F.lit(0).alias("role"), F.lit(0).cast("long").alias("bin")))
        return rows.withColumn("_at", F.explode(F.when(F.col("_large"), many).otherwise(one))).select(name, *names, "_a", "_b", "_at")

    lefts, rights = placed(left, "l", left_span, True), placed(right, "r", right_span, False).withColumnsRenamed({"_a": "_c", "_b": "_d"})
    once = (F.col("_at.on") == _WHOLE) | (F.col("_at.bin") == F.expr("shiftright(greatest(_a, _c), _at.on)"))
    return lefts.join(rights, [*names, "_at"]).where((F.col("_a") < F.col("_d")) & (F.col("_b") > F.col("_c")) & once).select("l", "r")
