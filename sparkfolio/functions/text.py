"""Text expressions that several operators use."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at either end (Unicode)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once: an array of one, transformed. A column inside a lambda would be worked out for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def once(df: DataFrame) -> DataFrame:
    """The same rows, each column worked out once: the optimizer copies a column into every filter and expression that uses it, but not through a generator."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def has_any(c: Column, words: str) -> Column:
    """Whether a text holds one of some words (a pattern of plain words, ``a|b``). Much quicker than the pattern."""
    return reduce(or_, [c.contains(w) for w in words.split("|")])


def running_sums(numbers: Column) -> Column:
    """The sums of an int array up to each place: within runs of about the square root of its size, then over the runs, so no step copies a long array."""
    none = F.array().cast("array<int>")
    last = lambda s: F.coalesce(F.get(s, F.size(s) - 1), F.lit(0))
    sums = lambda c: F.aggregate(c, none, lambda s, x: F.concat(s, F.array(last(s) + x)))

    def by_runs(a):
        step = F.ceil(F.sqrt(F.size(a))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.size(a) - 1, step), lambda at: sums(F.slice(a, at + 1, step)))
        before = lambda r: F.concat(F.array(F.lit(0)), sums(F.transform(r, last)))
        return let(runs, lambda r: let(before(r), lambda b: F.flatten(F.transform(r, lambda run, i: F.transform(run, lambda x: x + F.get(b, i))))))

    return F.when(F.size(numbers) > 0, let(numbers, by_runs)).otherwise(none)


def find_all(c: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of all matches, positions counted from 0. For patterns that match something.

    Spark's regex functions give texts without positions; the texts between matches (split) and the matches add up to them.
    """
    both = F.struct(F.split(c, pattern, -1).alias("between"), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("found"))

    def placed(p):
        steps = F.transform(p["found"], lambda m, i: F.length(F.get(p["between"], i)) + F.coalesce(F.length(F.get(p["found"], i - 1)), F.lit(0)))
        return let(running_sums(steps), lambda at: F.transform(p["found"], lambda m, i: F.struct(F.get(at, i).alias("start"), (F.get(at, i) + F.length(m)).alias("end"), m.alias("match"))))

    return let(both, placed)


def question_type(title: Column) -> Column:
    """Question type that a heading names."""
    return F.when(title.contains("选择"), "choice").when(title.contains("填空"), "fill_blank").when(title.rlike("解答|证明|计算"), "solution").otherwise("unknown")
