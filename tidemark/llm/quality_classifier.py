"""Quality classifier: document evidence combined with host and path posteriors (operator 2).

A logistic classifier gives each document a log likelihood ratio.  Hosts and
the paths under them have Beta-distributed shares of good documents; their
posteriors come from grouped sums, with sparse paths shrunk toward their host
and sparse hosts toward the global share.  Prior strengths are estimated from
the spread between sites (empirical Bayes).
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, stage

_MARKS = re.compile(r"[^\w\s]{2,}").findall


def features(text: str) -> set[str]:
    """Distinct lower-cased words without outer punctuation, runs of symbols, and binned shape statistics."""
    words = text.lower().split()
    distinct = set(words)
    found = {w.strip(".,;:!?()[]\"'") for w in distinct}
    found.discard("")
    found.update("\0mark " + m for m in set(_MARKS(text)))
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = sum(map(text.count, "#*$%&|<>"))
    found.add(f"\0words {n.bit_length()}")
    found.add(f"\0repeats {round(10 * (1 - len(distinct) / n)) if n else -1} of {n.bit_length()}")
    found.add(f"\0symbols {min(10, round(20 * symbols / max(1, len(text))))}")
    found.add(f"\0same lines {round(5 * (1 - len(set(lines)) / len(lines))) if lines else -1}")
    return found


def _select_features(labelled: DataFrame, n_good: int, n_bad: int, least_z: float, most: int) -> list[str]:
    """The features whose log odds ratio is at least ``least_z`` standard errors from zero, ``most`` at most."""

    def count(batches):
        held: dict[str, list[int]] = {}

        def flush():
            names = list(held)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([held[f][0] for f in names]), pa.array([held[f][1] for f in names])], names=["feature", "bad", "good"])
            held.clear()

        for batch in batches:
            for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in features(text or ""):
                    held.setdefault(f, [0, 0])[good] += 1
                if len(held) > 300_000:
                    yield from flush()
        if held:
            yield from flush()

    counts = labelled.mapInArrow(count, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("b"), F.sum("good").alias("g"))
    odds = lambda c, n: F.log((F.col(c) + 0.5) / (n - F.col(c) + 0.5))
    error = F.sqrt(1 / (F.col("g") + 0.5) + 1 / (F.col("b") + 0.5))
    ranked = counts.where(F.col("g") + F.col("b") >= 3).select("feature", (F.abs(odds("g", n_good) - odds("b", n_bad)) / error).alias("z"))
    return [f for f, _ in ranked.where(F.col("z") >= least_z).orderBy(F.desc("z"), "feature").limit(most).collect()]


def fit_logistic(rows: list[list[int]], good: np.ndarray, size: int, ridge: float = 1e-3, steps: int = 400) -> tuple[float, np.ndarray]:
    """Ridge logistic regression on binary features, given as index lists, by Adam steps over all rows."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([i for r in rows for i in r], np.int64)
    # unit length, so that long texts do not outweigh short ones
    scale = 1 / np.sqrt(np.maximum(1, [len(r) for r in rows]))
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = w[-1] + scale * np.bincount(row, weights=w[col], minlength=len(rows))
        error = 1 / (1 + np.exp(-z)) - good
        g = np.append(np.bincount(col, weights=(error * scale)[row], minlength=size), error.sum()) / len(rows) + ridge * np.append(w[:-1], 0) / max(1, len(rows)) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.3 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return float(w[-1]), w[:-1]


def learn_weights(labelled: DataFrame, least_z: float = 3.0, most: int = 4000) -> tuple[float, float, dict[str, float]]:
    """(prior log odds, intercept, feature weights) from (doc_id, text, good), a bounded number of rows.

    Without rows of either class there is nothing to learn.
    """
    n_good, n_bad = labelled.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum(1 - F.col("good")), F.lit(0))).first()
    if not n_good or not n_bad:
        return 0.0, 0.0, {}
    chosen = _select_features(labelled.select("text", "good"), n_good, n_bad, least_z, most)
    place = {f: i for i, f in enumerate(chosen)}

    def index(batches):
        for batch in batches:
            found = [sorted(place[f] for f in features(t or "") & place.keys()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "good", "found"])

    rows = labelled.select("doc_id", "text", "good").mapInArrow(index, "doc_id long, good long, found array<int>").toArrow().sort_by([("doc_id", "ascending")])
    bias, weights = fit_logistic(rows["found"].to_pylist(), rows["good"].to_numpy().astype(float), len(chosen))
    return math.log(n_good / n_bad), bias, dict(zip(chosen, weights.tolist()))


def document_evidence(docs: DataFrame, prior: float, bias: float, weights: dict[str, float], limit: float = 12.0) -> DataFrame:
    """``docs`` with ``evidence`` instead of text: the classifier's log odds of good, less the prior's."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at, keep = docs.columns.index("text"), [c for c in docs.columns if c != "text"]

    def run(batches):
        known = shared.value
        names = known.keys()
        for batch in batches:
            sums = []
            for text in batch.column(at).to_pylist():
                found = sorted(known[f] for f in features(text or "") & names)
                log_odds = bias + sum(found) / math.sqrt(max(1, len(found))) - prior
                sums.append(max(-limit, min(limit, log_odds)))
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.float64())], names=[*keep, "evidence"])

    kept = docs.select(*keep).schema.add("evidence", "double")
    return docs.mapInArrow(run, kept)


def _strength(sites: DataFrame, parent: Column, least: float = 2.0, most: float = 1000.0) -> float:
    """Prior strength of a level by moments: how little the sites' shares spread beyond chance.

    ``sites`` has good and n; ``parent`` is the mean each site is drawn around.
    """
    share, n = F.col("good") / F.col("n"), F.col("n")
    chance = parent * (1 - parent) / n
    spread, expected, between = sites.where("n >= 2").agg(
        F.sum(n * (share - parent) ** 2), F.sum(n * chance), F.sum((n - 1) * parent * (1 - parent))
    ).first()  # E[n (share - parent)^2] = p (1 - p) (1 + (n - 1) / (strength + 1))
    if not between or spread <= expected:
        return most
    return min(most, max(least, between / (spread - expected) - 1))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5, max_labelled: int = 20_000) -> DataFrame:
    """doc_id, doc_score, host_score, path_score, score, kept for every row of ``docs`` (doc_id, text and what host and path read).

    ``doc_score`` is the document's own probability of being good (quality 1
    and not toxic), ``host_score`` and ``path_score`` the posterior share of
    good documents of its site, without the document itself, and ``score`` the
    document's evidence on top of the path's share as prior.  Null hosts and
    paths are values of their own.  Labels of unknown documents are ignored,
    a document with several labels is good only if all say so, and null labels
    say nothing.  Without labels of both classes every score is 0.5 and every
    row is kept.  Null texts have no words; repeated rows are scored one by one.

    The classifier is fitted on at most ``max_labelled`` labelled documents, the
    first by a hash of their id; site shares cover all rows.
    """
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("long")
    known = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = stage(known.select(F.col("doc_id").cast("long"), good.alias("good")).groupBy("doc_id").agg(F.min("good").alias("good")), "labels")
    sample = stage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "labelled")
    fitted_on = join_checked(docs.select(F.col("doc_id").cast("long"), "text"), sample, "doc_id", "inner").groupBy("doc_id", "good").agg(F.min("text").alias("text"))
    prior, bias, weights = learn_weights(stage(fitted_on, "labelled-texts"))

    text_of = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("?"))
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(text_of(host)).alias("host"), F.xxhash64(text_of(host), text_of(path)).alias("path"))
    scored = stage(document_evidence(keyed, prior, bias, weights).withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + prior)))), "evidence")

    paths = stage(scored.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count("*").cast("double").alias("n")), "paths")
    hosts = stage(paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), "hosts")
    total, n = hosts.agg(F.coalesce(F.sum("good"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    share = (total + 1.0) / (n + 2.0)
    k_host = _strength(hosts, F.lit(share))
    host_mean = (k_host * share + F.col("good")) / (k_host + F.col("n"))
    under = join_checked(paths, hosts.select("host", host_mean.alias("mean")), "host")
    k_path = _strength(under, F.col("mean"))

    sites = hosts.select("host", F.col("good").alias("host_good"), F.col("n").alias("host_n"))
    sites = stage(join_checked(paths, sites, "host").select("path", "host_good", "host_n", F.col("good").alias("path_good"), F.col("n").alias("path_n")), "sites")
    rows = join_checked(scored, sites, "path")
    # the document's own part is taken out of its site, so its evidence counts once
    rows = rows.withColumn("host_score", (k_host * share + F.col("host_good") - F.col("p")) / (k_host + F.col("host_n") - 1))
    rows = rows.withColumn("path_score", (k_path * F.col("host_score") + F.col("path_good") - F.col("p")) / (k_path + F.col("path_n") - 1))
    site = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_score")))
    final = 1 / (1 + F.exp(-(F.col("evidence") + F.log(site / (1 - site)))))
    if not weights and not prior:
        final = F.lit(0.5)
    rows = rows.withColumn("score", final)
    return rows.select("doc_id", F.col("p").alias("doc_score"), "host_score", "path_score", "score", (F.col("score") >= threshold).alias("kept"))
