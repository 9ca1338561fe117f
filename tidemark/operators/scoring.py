"""Scores of verdicts and runs against labelled truth."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import ratio
from tidemark.operators.fingerprints import differences


def match_truth(verdicts: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join on the site: ``bucket`` (invisible where truth has no verdict) and ``is_true``.

    Sites are counted once: several verdicts on one site count as the
    strongest (proposed, then flagged, then rejected).
    """
    rank = F.when(F.col("bucket") == "proposed", 0).when(F.col("bucket") == "flagged", 1).otherwise(2)
    one = verdicts.groupBy(*on).agg(F.min_by("bucket", rank).alias("bucket"))
    both = one.join(truth.dropDuplicates(on).withColumn("is_true", F.lit(True)), on, "full_outer")
    return both.withColumns({"bucket": F.coalesce("bucket", F.lit("invisible")), "is_true": F.coalesce("is_true", F.lit(False))})


def score_columns(empty_precision: float = float("nan")) -> list[Column]:
    """Counts and ratios of a matched table; ``empty_precision`` is the value where nothing is proposed.

    Ratios come from summed counts, so a grand total is a micro average.
    Surfaced recall counts flagged truth as found.
    """
    proposed = F.col("bucket") == "proposed"
    tp, fp = F.count_if(proposed & F.col("is_true")), F.count_if(proposed & ~F.col("is_true"))
    n = F.count_if(F.col("is_true"))
    flagged = F.count_if((F.col("bucket") == "flagged") & F.col("is_true"))
    return [
        tp.alias("tp"), fp.alias("fp"), (n - tp).alias("fn"), flagged.alias("fn_flagged"),
        F.count_if((F.col("bucket") == "rejected") & F.col("is_true")).alias("fn_rejected"), F.count_if((F.col("bucket") == "invisible") & F.col("is_true")).alias("fn_invisible"),
        ratio(tp, tp + fp, empty_precision).alias("precision"), ratio(tp, n, 1.0).alias("recall"), ratio(tp + flagged, n, 1.0).alias("surfaced_recall"),
    ]


def score(matched: DataFrame, by: list[str] | None = None, empty_precision: float = float("nan")) -> DataFrame:
    """Scores over all rows, or per group."""
    return matched.groupBy(*(by or [])).agg(*score_columns(empty_precision))


def score_rollup(matched: DataFrame, by: list[str], empty_precision: float = float("nan")) -> DataFrame:
    """Scores per group at every level of ``by``, and the grand total (nulls)."""
    return matched.rollup(*by).agg(*score_columns(empty_precision))


def acceptance(matched: DataFrame) -> DataFrame:
    """Surfaced recall, and precision that is one when nothing is proposed."""
    return score(matched, empty_precision=1.0).select("surfaced_recall", "precision")


def attribute_losses(truth: DataFrame, raw: DataFrame, kept: DataFrame, on: list[str], verdicts: DataFrame | None = None) -> DataFrame:
    """Per truth site: scan_missed (never a candidate), prefilter_dropped, or reachable.

    With ``verdicts`` the reachable ones are proposed, flagged or rejected, or
    invisible where they have none.
    """
    found = raw.select(*on).distinct().withColumn("was_raw", F.lit(True))
    left = kept.select(*on).distinct().withColumn("was_kept", F.lit(True))
    route = F.when(F.col("was_kept"), "reachable").when(F.col("was_raw"), "prefilter_dropped").otherwise("scan_missed")
    routed = truth.join(found, on, "left").join(left, on, "left").withColumn("route", route).drop("was_raw", "was_kept")
    if verdicts is None:
        return routed
    buckets = match_truth(verdicts, truth, on).select(*on, "bucket")
    return routed.join(buckets, on, "left").withColumn("route", F.when(F.col("route") == "reachable", F.col("bucket")).otherwise(F.col("route"))).drop("bucket")


def set_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(op, n): how many distinct rows are in both, in the first alone, and in either."""
    both = a.distinct().withColumn("_a", F.lit(1)).join(b.distinct().withColumn("_b", F.lit(1)), a.columns, "full_outer")
    counts = both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_b").isNull()).alias("first_only"), F.count("*").alias("either"))
    return counts.unpivot([], ["both", "first_only", "either"], "op", "n")


def ranges(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Least and greatest of each column over the runs of a group."""
    return rows.groupBy(*by).agg(*[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))])


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows only one of the two has, copies counted; only parts whose fingerprints differ are compared."""
    return differences(a, b).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_different"))


#: Calls that look names up at run time.
DYNAMIC = r"getattr\(|\bdir\(|importlib|globals\(\)|locals\(\)"


def site_class(file: Column, tags: Column, snippet: Column, client_folders: Sequence[str] = (), decorator_tags: Sequence[str] = ()) -> Column:
    """Difficulty class of a candidate, first rule first: test path, client folder, decorator tag, dynamic form, or literal."""
    among = F.array(*[F.lit(t) for t in decorator_tags]).cast("array<string>")
    in_client = reduce(lambda a, b: a | b, [F.contains(file, F.lit(m)) for m in client_folders], F.lit(False))
    return (
        F.when(F.contains(F.lower(file), F.lit("test")), "test/mock")
        .when(in_client, "client-side")
        .when(F.coalesce(F.arrays_overlap(tags, among), F.lit(False)), "decorator/registration")
        .when(snippet.rlike(DYNAMIC), "dynamic/reflection")
        .otherwise("literal")
    )


def with_class(candidates: DataFrame, truth: DataFrame, on: list[str], fallback: Column) -> DataFrame:
    """Candidates with ``class``: that of the truth where it has the site, else ``fallback``."""
    known = truth.select(*on, F.col("class").alias("_class")).dropDuplicates(on)
    return candidates.join(known, on, "left").withColumn("class", F.coalesce("_class", fallback)).drop("_class")
