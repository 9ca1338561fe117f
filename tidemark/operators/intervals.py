"""Containment of intervals within groups, without comparing every pair.

Intervals are [start, end] with start <= end; an interval lies in another of
its group if that one starts no later and ends no earlier.  ``mark_contained``
sorts both sides and carries the largest end seen so far; ``contained_pairs``
lists the pairs, through an equi-join on dyadic nodes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of one segment of a sweep.
SEGMENT = 1 << 16


def _only(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """The columns of an interval side under fixed names; rows without a start, an end, or with end < start hold nothing."""
    named = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
    return named.where(F.col("_s") <= F.col("_e"))


def mark_contained(spans: DataFrame, covers: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", cover_start: str = "start", cover_end: str = "end", name: str = "contained", segment: int = SEGMENT) -> DataFrame:
    """``spans`` with a boolean ``name``: whether some interval of ``covers`` in the same group contains the span.

    A span is contained exactly if the largest end among the covers that start
    no later reaches its own end, so one sorted pass with a running maximum
    answers for all spans, in linear time after the sort.  A group is swept in
    segments of ``segment`` positions; each starts with the largest end of the
    segments before it.  So no task holds a whole group, and of the many covers
    or spans that start at one position only the distinct ones are swept.

    Null keys are equal to each other.  A span with a null or with end < start
    is not contained.
    """
    key = [f"_k{i}" for i in range(len(keys))]
    at = F.floor(F.col("_s") / segment).alias("_g")
    inner = _only(spans, keys, start, end).distinct().select(*key, at, "_s", F.lit(1).alias("_kind"), "_e")
    outer = _only(covers, keys, cover_start, cover_end).groupBy(*key, "_s").agg(F.max("_e").alias("_e")).select(*key, at, "_s", F.lit(0).alias("_kind"), "_e")
    events = inner.unionByName(outer)
    cover_end_of = F.when(F.col("_kind") == 0, F.col("_e"))
    segments = events.groupBy(*key, "_g").agg(F.max(cover_end_of).alias("_top"))
    before = segments.withColumn("_carry", F.max("_top").over(Window.partitionBy(*key).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)))
    sweep = Window.partitionBy(*key, "_g").orderBy("_s", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("_top", F.max(cover_end_of).over(sweep)).where("_kind = 1")
    same = lambda a, b, names: [a[n].eqNullSafe(b[n]) for n in names]
    joined = swept.join(before.select(*[F.col(k).alias(f"_b{k}") for k in key], F.col("_g").alias("_bg"), "_carry"), [*[F.col(k).eqNullSafe(F.col(f"_b{k}")) for k in key], F.col("_g") == F.col("_bg")])
    found = joined.where(F.greatest("_top", "_carry") >= F.col("_e")).select(*[F.col(k).alias(f"_f{k}") for k in key], F.col("_s").alias("_fs"), F.col("_e").alias("_fe"), F.lit(True).alias("_hit"))
    on = [F.col(k).eqNullSafe(F.col(f"_f_k{i}")) for i, k in enumerate(keys)]
    on += [F.col(start).cast("long") == F.col("_fs"), F.col(end).cast("long") == F.col("_fe")]
    return spans.join(found, on, "left").select(*[spans[c] for c in spans.columns], F.coalesce("_hit", F.lit(False)).alias(name))


def dyadic_cover(low: Column, high: Column, levels: int) -> Column:
    """The nodes (level, place) whose blocks [place * 2^level, (place + 1) * 2^level) make up [low, high].

    On every level at most the first and the last block are taken, the rest
    belongs to their parents, so there are at most two nodes a level.
    """

    def step(state: Column, level: Column) -> Column:
        a, b, out = state["a"], state["b"], state["out"]
        open_ = a <= b
        left = open_ & (F.pmod(a, F.lit(2)) == 1)
        right = open_ & (F.pmod(b, F.lit(2)) == 0)
        node = lambda place: F.array(F.struct(level.cast("int").alias("level"), place.alias("place")))
        none = F.array().cast("array<struct<level:int,place:bigint>>")
        out = F.concat(out, F.when(left, node(a)).otherwise(none), F.when(right, node(b)).otherwise(none))
        up_a, up_b = F.floor((a + 1) / 2), F.floor((b - 1) / 2)
        return F.struct(F.when(open_, up_a).otherwise(F.lit(1).cast("long")).alias("a"), F.when(open_, up_b).otherwise(F.lit(0).cast("long")).alias("b"), out.alias("out"))

    start = F.struct(low.cast("long").alias("a"), high.cast("long").alias("b"), F.array().cast("array<struct<level:int,place:bigint>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step)["out"]


def contained_pairs(spans: DataFrame, covers: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", cover_start: str = "start", cover_end: str = "end", levels: int = 40) -> DataFrame:
    """All (span, cover) pairs of a group in which the cover contains the span.

    Returns the keys, start, end, cover_start and cover_end; repeated rows of
    either side are one.  Positions are 0 or more and below 2^``levels``.

    A cover is cut into at most two dyadic blocks a level; the start of a span
    lies in one block of each level.  They meet in an equi-join on (group,
    level, block), exactly once for each pair in which the cover holds the
    span's start, and the ends are compared then.  A frequent block is a skewed
    key that adaptive execution splits.  Null keys are equal to each other.
    """
    key = [f"_k{i}" for i in range(len(keys))]
    inner = _only(spans, keys, start, end).distinct()
    outer = _only(covers, keys, cover_start, cover_end).distinct().withColumnsRenamed({"_s": "_cs", "_e": "_ce"} | {k: f"_c{k}" for k in key})
    nodes = outer.select("*", F.explode(dyadic_cover(F.col("_cs"), F.col("_ce"), levels)).alias("_n")).select("*", F.col("_n.level").alias("_cl"), F.col("_n.place").alias("_cp")).drop("_n")
    # levels on which no cover has a block need no rows of spans
    used = F.broadcast(nodes.select(F.col("_cl").alias("_l")).distinct())  # at most ``levels`` rows
    places = inner.crossJoin(used).withColumn("_p", F.call_function("shiftright", F.col("_s"), F.col("_l")))
    on = [F.col(k).eqNullSafe(F.col(f"_c{k}")) for k in key] + [F.col("_l") == F.col("_cl"), F.col("_p") == F.col("_cp")]
    met = places.join(nodes, on).where(F.col("_e") <= F.col("_ce"))
    return met.select(*[F.col(a).alias(b) for a, b in zip(key, keys)], F.col("_s").alias("start"), F.col("_e").alias("end"), F.col("_cs").alias("cover_start"), F.col("_ce").alias("cover_end"))
