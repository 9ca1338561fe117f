"""Comparing two tables as multisets by fingerprints, row by row only where they differ.

A fingerprint of a set of rows is their number and the exact sums of two
independent row hashes.  Sums do not depend on order, count copies, and add up:
the fingerprint of a node of a tree over hash buckets is the sum of those of
its children.  Two tables are compared from the root down, and only rows of
buckets that differ are compared themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import stage

SUMS = ("n", "h1", "h2")


def row_hash(columns: Sequence[str], salt: int) -> Column:
    """A hash of a row; nulls count, also which column has them."""
    return F.xxhash64(F.lit(salt), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def bucket_of(columns: Sequence[str], buckets: int) -> Column:
    return F.pmod(row_hash(columns, 0), F.lit(buckets))


def fingerprints(rows: DataFrame, columns: Sequence[str], buckets: int = 1 << 12) -> DataFrame:
    """(bucket, n, h1, h2): at most ``buckets`` rows, added up before and after the shuffle.

    Hashes are added as decimals of 38 digits, which 10^18 rows do not fill.
    """
    exact = lambda salt: F.sum(row_hash(columns, salt).cast("decimal(20,0)")).cast("decimal(38,0)")
    return rows.groupBy(bucket_of(columns, buckets).alias("bucket")).agg(F.count("*").alias("n"), exact(1).alias("h1"), exact(2).alias("h2"))


def roll_up(prints: DataFrame, fanout: int) -> DataFrame:
    """The next level: each node adds up ``fanout`` buckets."""
    return prints.groupBy(F.floor(F.col("bucket") / fanout).alias("bucket")).agg(F.sum("n").alias("n"), *[F.sum(h).cast("decimal(38,0)").alias(h) for h in ("h1", "h2")])


def _unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bucket): nodes of one level that differ or that one side alone has."""
    other = b.select("bucket", *[F.col(c).alias(f"_{c}") for c in SUMS])
    same = F.lit(True)
    for c in SUMS:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(other, "bucket", "full_outer").where(~same).select("bucket")


def differing_buckets(a: DataFrame, b: DataFrame, buckets: int = 1 << 12, fanout: int = 16) -> DataFrame:
    """(bucket): leaves whose fingerprints differ, from two tables of fingerprints.

    Levels are compared from the root down; below a node that is equal nothing
    is looked at, and equal roots end the comparison.
    """
    levels = [(a, b)]
    while fanout ** len(levels) < buckets * fanout and len(levels) < 64:
        levels.append(tuple(roll_up(x, fanout) for x in levels[-1]))
    found = None
    for x, y in reversed(levels):
        if found is not None:
            parents = found.withColumnRenamed("bucket", "_parent")
            x, y = (d.join(F.broadcast(parents), F.floor(F.col("bucket") / fanout) == F.col("_parent"), "left_semi") for d in (x, y))  # at most ``buckets`` rows
        found = stage(_unequal(x, y), "differing")
        if not found.limit(1).count():
            break
    return found if found.limit(1).count() else found.limit(0)


def differences(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None, buckets: int = 1 << 12, fanout: int = 16) -> DataFrame:
    """(side, *columns, n): rows that one table has more often than the other, and by how many copies.

    ``side`` is ``first`` or ``second``.  Both tables are read once for the
    fingerprints; rows are shuffled only from buckets that differ, so equal
    tables shuffle no row.
    """
    columns = list(columns or a.columns)
    prints = [stage(fingerprints(d, columns, buckets), "fingerprints") for d in (a, b)]
    found = F.broadcast(differing_buckets(*prints, buckets, fanout))  # at most ``buckets`` rows
    counted = [d.select(*columns).join(found, bucket_of(columns, buckets) == F.col("bucket"), "left_semi").withColumn("_n", F.lit(sign)) for d, sign in zip((a, b), (1, -1))]
    left = counted[0].unionByName(counted[1]).groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return left.select(F.when(F.col("_n") > 0, "first").otherwise("second").alias("side"), *columns, F.abs("_n").alias("n"))
