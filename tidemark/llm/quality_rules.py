"""Quality rules: base counts, then robust multivariate outliers per language and source (operator 1).

Everything here is DataFrame functions.  The minimum-covariance-determinant
estimate of each (language, source) group comes from concentration steps over
grouped aggregates: distances to the present estimate, the group's order
statistic that covers the wanted share, and the moments of the rows below it.
Two deterministic starts run side by side and the smaller determinant wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, stage, words_of

#: Transformed statistics and the least standard deviation that each may have in an estimate.
FEATURES = {
    "log_words": 0.30,
    "log_word_chars": 0.06,
    "symbol_share": 0.05,
    "dup_line_share": 0.10,
    "repeat_share": 0.10,
}
#: Quantiles of the chi-square distribution with five degrees of freedom: half, 0.975, 1 - 7e-8.
CHI2_HALF, CHI2_975, CHI2_REJECT = 4.351, 12.833, 41.6
#: Consistency factor of a covariance of the 0.975 core: 0.975 / P(chi2 with 7 degrees <= CHI2_975).
CORE_FACTOR = 0.975 / 0.9237

_P = list(FEATURES)
_PAIRS = [(i, j) for i in range(len(_P)) for j in range(i + 1)]


def with_base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words of whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id"), F.col("lang"), F.col("source"), text.alias("_t"))
    d = d.select("*", words_of(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    n = F.size("_w")
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(F.col("_w"), i), F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2)))
    d = d.select("*", F.when(n >= 3, windows).alias("_h"))
    by_hash = F.array_sort(F.transform(F.col("_h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # most texts repeat no window; only the others are sorted
    d = d.select("*", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), by_hash).alias("_s"))
    repeated = F.filter(F.col("_s"), lambda s, k: (F.get(F.col("_s"), k - 1)["h"] == s["h"]) | (F.get(F.col("_s"), k + 1)["h"] == s["h"]))
    d = d.select("*", F.array_sort(F.transform(repeated, lambda s: s["i"])).alias("_p"))
    # a window covers three words or as many as lie before the next one; least() skips the null after the last
    covered = F.aggregate(F.transform("_p", lambda p, k: F.least(F.lit(3), F.get(F.col("_p"), k + 1) - p)), F.lit(0), lambda a, x: a + x)
    return d.select(
        "doc_id",
        "lang",
        "source",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.translate("_t", " \t\n\u000b\f\r", "")).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _features(d: DataFrame) -> DataFrame:
    """Add the transformed statistics; shares go through the variance-stabilising arcsine of their root.

    A share's denominator is raised by a constant, so that one repeated line
    among three says less than a hundred among three hundred.
    """
    share = lambda a, b, more: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / (F.col(b) + F.lit(more)))))
    return d.select(
        "*",
        F.log1p("n_words").alias("log_words"),
        F.log1p(F.col("word_chars") / F.greatest("n_words", F.lit(1))).alias("log_word_chars"),
        share("n_symbols", "word_chars", 50).alias("symbol_share"),
        share("n_dup_lines", "n_lines", 5).alias("dup_line_share"),
        share("n_repeat_words", "n_words", 50).alias("repeat_share"),
    )


def _d2(s: str) -> Column:
    """Squared Mahalanobis distance to estimate ``s``, given the inverse Cholesky factor as columns."""
    rows = []
    for i in range(len(_P)):
        y = reduce(lambda a, b: a + b, [F.col(f"{s}w{i}_{j}") * (F.col(_P[j]) - F.col(f"{s}m{j}")) for j in range(i + 1)])
        rows.append(y * y)
    return reduce(lambda a, b: a + b, rows)


def _factor(d: DataFrame, s: str, scale: float = 1.0) -> DataFrame:
    """From mean and covariance columns of estimate ``s``: inverse Cholesky factor and log determinant.

    Each variance is raised by its floor, so a constant statistic or a tiny
    group still has an invertible covariance.
    """
    n = range(len(_P))
    a = {(i, j): F.coalesce(F.col(f"{s}c{i}_{j}"), F.lit(0.0)) * scale + (FEATURES[_P[i]] ** 2 if i == j else 0.0) for i, j in _PAIRS}
    d = d.withColumns({f"_a{i}_{j}": x for (i, j), x in a.items()})
    minus = lambda first, terms: reduce(lambda x, y: x - y, terms, first)
    for j in n:  # one column of the factor after the other
        diagonal = F.sqrt(F.greatest(minus(F.col(f"_a{j}_{j}"), [F.col(f"_l{j}_{k}") * F.col(f"_l{j}_{k}") for k in range(j)]), F.lit(1e-12)))
        below = {f"_l{i}_{j}": minus(F.col(f"_a{i}_{j}"), [F.col(f"_l{i}_{k}") * F.col(f"_l{j}_{k}") for k in range(j)]) / diagonal for i in n if i > j}
        d = d.withColumns({f"_l{j}_{j}": diagonal, **below})
    for i in n:  # one row of its inverse after the other
        row = {f"{s}w{i}_{i}": 1 / F.col(f"_l{i}_{i}")}
        for j in range(i):
            row[f"{s}w{i}_{j}"] = minus(F.lit(0.0), [F.col(f"_l{i}_{k}") * F.col(f"{s}w{k}_{j}") for k in range(j, i)]) / F.col(f"_l{i}_{i}")
        d = d.withColumns(row)
    logdet = reduce(lambda x, y: x + y, [2 * F.log(F.col(f"_l{i}_{i}")) for i in n])
    return d.withColumn(f"{s}logdet", logdet).drop(*[c for c in d.columns if c.startswith(("_a", "_l"))])


def _moments(s: str, keep: Column) -> list[Column]:
    """Aggregates of the mean and covariance over the rows where ``keep`` holds."""
    at = [F.when(keep, F.col(p)) for p in _P]
    return [F.avg(at[i]).alias(f"{s}m{i}") for i in range(len(_P))] + [F.covar_pop(at[i], at[j]).alias(f"{s}c{i}_{j}") for i, j in _PAIRS]


def _columns(s: str) -> list[str]:
    return [f"{s}m{i}" for i in range(len(_P))] + [f"{s}w{i}_{j}" for i, j in _PAIRS] + [f"{s}logdet"]


def robust_estimates(rows: DataFrame, share: float = 0.75, steps: int = 3, accuracy: int = 2000) -> DataFrame:
    """One MCD estimate per ``grp``: number of rows, centre and covariance of the core (fm, fc columns), one row each.

    ``share`` of a group's rows make the core; its order statistic is an
    approximate percentile with rank error 1/``accuracy``, whose sketches merge,
    so a group of any size never meets in one task.
    """
    n = range(len(_P))
    median = rows.groupBy("grp").agg(*[F.percentile_approx(p, 0.5, accuracy).alias(f"am{i}") for i, p in enumerate(_P)])
    median = stage(median, "mcd-median")
    spread = join_checked(rows, median, "grp").groupBy("grp").agg(
        *[F.first(f"am{i}").alias(f"am{i}") for i in n],
        *[F.percentile_approx(F.abs(F.col(p) - F.col(f"am{i}")), 0.5, accuracy).alias(f"mad{i}") for i, p in enumerate(_P)],
        *_moments("b", F.lit(True)),
    )
    # start a: medians and scaled absolute deviations; start b: plain moments
    start = spread.withColumns({f"ac{i}_{j}": (1.4826 * F.col(f"mad{i}")) ** 2 if i == j else F.lit(0.0) for i, j in _PAIRS})
    estimate = stage(_factor(_factor(start, "a"), "b").select("grp", *_columns("a"), *_columns("b")), "mcd-start")
    for _ in range(steps):
        near = join_checked(rows, estimate, "grp").select("grp", *_P, _d2("a").alias("ad"), _d2("b").alias("bd"))
        cut = stage(near.groupBy("grp").agg(F.percentile_approx("ad", share, accuracy).alias("acut"), F.percentile_approx("bd", share, accuracy).alias("bcut")), "mcd-cut")
        core = join_checked(near, cut, "grp").groupBy("grp").agg(*_moments("a", F.col("ad") <= F.col("acut")), *_moments("b", F.col("bd") <= F.col("bcut")))
        estimate = stage(_factor(_factor(core, "a"), "b").select("grp", *_columns("a"), *_columns("b")), "mcd-step")
    first = F.col("alogdet") <= F.col("blogdet")
    best = estimate.select("grp", *[F.when(first, F.col("a" + c[1:])).otherwise(F.col(c)).alias("r" + c[1:]) for c in _columns("b")])
    # reweighting: scale the distances so that their median is that of chi-square, then moments of the 0.975 core
    near = join_checked(rows, stage(best, "mcd-raw"), "grp").select("grp", *_P, _d2("r").alias("rd"))
    scale = stage(near.groupBy("grp").agg((F.percentile_approx("rd", 0.5, accuracy) / CHI2_HALF).alias("scale")), "mcd-scale")
    core = join_checked(near, scale, "grp").groupBy("grp").agg(F.count("*").alias("n"), *_moments("f", F.col("rd") <= CHI2_975 * F.greatest(F.col("scale"), F.lit(1e-9))))
    return stage(core.withColumns({f"fc{i}_{j}": F.col(f"fc{i}_{j}") * CORE_FACTOR for i, j in _PAIRS}), "mcd")


def _shrunk(d: DataFrame, own: str, parent: str, out: str, prior: float) -> DataFrame:
    """Add estimate ``out``: centre and covariance of ``own`` with weight n / (n + prior), of ``parent`` with the rest.

    Nothing of its own (null) counts as no rows.  The gap between the centres
    adds nothing to the covariance: a site of a few odd rows would excuse them.
    """
    n = F.coalesce(F.col(f"{own}n"), F.lit(0))
    w = n / (n + prior)
    mixed = lambda c: F.col(f"{parent}{c}") + w * (F.coalesce(F.col(f"{own}{c}"), F.col(f"{parent}{c}")) - F.col(f"{parent}{c}"))
    return d.withColumns({f"{out}{c}": mixed(c) for c in [f"m{i}" for i in range(len(_P))] + [f"c{i}_{j}" for i, j in _PAIRS]})


def site_estimates(rows: DataFrame, sites: DataFrame, prior: float) -> DataFrame:
    """The estimate of every row of ``sites`` (site, language): its own, shrunk toward its language's, and that toward all rows'.

    ``rows`` has site, language and the statistics.  All three levels are
    estimated in one run, each row standing in a group of each.
    """
    levels = F.array(F.concat(F.lit("s"), "site"), F.concat(F.lit("l"), "language"), F.lit("a"))
    found = robust_estimates(rows.select(F.explode(levels).alias("grp"), *_P))
    named = lambda s: [F.col("grp").alias(f"{s}grp"), F.col("n").alias(f"{s}n"), *[F.col(f"f{c}").alias(f"{s}{c}") for c in [f"m{i}" for i in range(len(_P))] + [f"c{i}_{j}" for i, j in _PAIRS]]]
    d = sites.crossJoin(F.broadcast(found.where("grp = 'a'").select(*named("x"))))
    d = join_checked(d, found.where("grp LIKE 'l%'").select(*named("y")), F.col("ygrp") == F.concat(F.lit("l"), "language"))
    d = join_checked(d, found.where("grp LIKE 's%'").select(*named("z")), F.col("zgrp") == F.concat(F.lit("s"), "site"))
    d = _shrunk(_shrunk(d, "y", "x", "v", prior), "z", "v", "f", prior)
    d = stage(d.select("site", *[c for c in d.columns if c[:2] in ("fm", "fc")]), "mcd-shrunk")
    return stage(_factor(d, "f").select("site", *_columns("f")), "mcd-sites")


def apply_quality_rules(docs: DataFrame, min_words: int = 50, prior: float = 50.0, cutoff: float = CHI2_REJECT) -> DataFrame:
    """Base counts and verdict per row of ``docs`` (doc_id, text, lang, source).

    ``base_failed``: fewer than ``min_words`` words, or more than half of the
    words in repeated 3-word windows.  Every other row has a squared robust
    distance from its site's estimate; ``kept`` needs it at most ``cutoff``.
    A site is (lang, source), null counting as a value.  Every site has its
    own estimate, with weight n / (n + ``prior``) for its n rows that pass the
    base rules and the rest for its language, which is shrunk toward all rows
    in the same way; so no number of rows switches a verdict.

    A null text has no words, so it fails the base rules.  Null ids and
    repeated rows are kept as rows of their own; an empty table gives none.
    """
    rows = stage(_features(with_base_counts(docs)).withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "quality-counts")
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("?"))
    site, language = F.concat_ws("\u0001", tag("lang"), tag("source")), tag("lang")
    keyed = rows.select("*", site.alias("site"), language.alias("language"))
    passing = keyed.where(~F.col("base_failed"))
    sites = stage(passing.select("site", "language").distinct(), "quality-sites")
    found = join_checked(keyed, site_estimates(passing, sites, prior), "site")
    distance = F.when(~F.col("base_failed"), _d2("f"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (distance <= cutoff)).alias("kept"), distance.alias("distance2"),
    )
