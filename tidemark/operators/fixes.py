"""Proposed one-line fixes: applying, checking and classifying them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.source_code import imports_of, parse_error
from tidemark.functions.text import normalize_line, strip

#: What a fix can say.
FIX_VERDICTS = ("FIX", "FLAG-FOR-HUMAN", "SKIP")


class FixRunError(ValueError):
    """Fix runs that cannot be scored: a file that is missing, or one that breaks its contract."""


def read_fixes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, seq, id, file, line, original_line, verdict, proposed_line, reason) of JSON lists of fixes.

    Every path is an expected run: a run that is missing, or no list of fixes,
    stops the scoring, which would count it as a run of wrong answers.
    ``seq`` is the place in the list.
    """
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    of = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    missing = [p for p, at in zip(paths, of) if not at.getFileSystem(hadoop).exists(at)]
    if missing or not paths:
        raise FixRunError("no fix runs" if not paths else f"missing fix runs: {', '.join(missing)}")
    # wholetext, as the binary source gives no row for an empty file
    raw = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("doc"))
    if raw.count() < len(paths):
        raise FixRunError(f"{len(paths)} fix runs, {len(paths) - raw.count()} of them empty")
    listed = raw.select("path", F.try_variant_get("doc", "$", "array<variant>").alias("rows"))
    whole = F.when(F.col("rows").isNull(), F.array(F.lit(None).cast("variant"))).otherwise(F.col("rows"))
    rows = listed.select("path", F.posexplode(whole).alias("seq", "row"))
    get = lambda name, kind: F.try_variant_get("row", f"$.{name}", kind)
    kind = lambda name: F.coalesce(F.schema_of_variant(get(name, "variant")), F.lit("none"))
    bad = F.col("row").isNull() | (kind("id") != "STRING") | (kind("line") != "BIGINT") | ~F.coalesce(get("verdict", "string").isin(*FIX_VERDICTS), F.lit(False))
    if found := rows.where(bad).select("path", "seq").limit(5).collect():
        raise FixRunError("no fixes: " + ", ".join(f"{r.path}[{r.seq}]" for r in found))
    text = lambda name: get(name, "string").alias(name)
    return rows.select("path", "seq", text("id"), text("file"), get("line", "int").alias("line"), *map(text, ("original_line", "verdict", "proposed_line", "reason")))


def classify_line(proposed: Column, required: Column) -> Column:
    """exact (but for trailing space), semantic (equal once normalised) or wrong."""
    rstrip = lambda c: F.regexp_replace(c, r"(?U)\s+$", "")
    return F.when(rstrip(proposed) == rstrip(required), "exact").when(normalize_line(proposed) == normalize_line(required), "semantic").otherwise("wrong")


def score_fixes(fixes: DataFrame, key: DataFrame) -> DataFrame:
    """One row per id of the answer key: its class; ids a run lacks are ``missing``.

    A hedge is legitimate where the key allows one.  Where no one-line answer
    exists, a fix is wrong however plausible it looks.  Of repeated ids the
    last ``seq`` counts.
    """
    latest = fixes.groupBy("id").agg(F.max_by(F.struct("verdict", "proposed_line"), "seq").alias("f"))
    joined = key.join(latest, "id", "left")
    verdict = F.col("f.verdict")
    kind = (
        F.when(F.col("f").isNull(), "missing")
        .when(verdict == "FLAG-FOR-HUMAN", F.when(F.col("hedge_ok"), "hedge-legitimate").otherwise("hedge-avoidable"))
        .when(verdict == "SKIP", "wrong-skip")
        .when(~F.col("has_single_line_fix"), "locally-plausible-but-globally-wrong")
        .otherwise(classify_line(F.col("f.proposed_line"), F.col("required_line")))
    )
    return joined.select("id", kind.alias("class"))


def unknown_ids(fixes: DataFrame, key: DataFrame) -> DataFrame:
    """Ids that the answer key does not have."""
    return fixes.select("id").distinct().join(key, "id", "left_anti")


def disagreements(fixes: DataFrame, lines: DataFrame) -> DataFrame:
    """Fixes whose original line is not what the file has there (or is out of range)."""
    at = lines.select("file", "line", F.col("text").alias("_now"))
    same = strip(F.col("_now")) == strip(F.col("original_line"))
    return fixes.join(at, ["file", "line"], "left").where(~F.coalesce(same, F.lit(False))).drop("_now")


def apply_fixes(lines: DataFrame, fixes: DataFrame, key: str = "file") -> DataFrame:
    """(key, text): files with their FIX lines replaced, joined by line feeds."""
    new = fixes.where("verdict = 'FIX'").groupBy(key, "line").agg(F.max("proposed_line").alias("_new"))
    merged = lines.join(new, [key, "line"], "left").select(key, "line", F.coalesce("_new", "text").alias("text"))
    rows = F.array_sort(F.collect_list(F.struct("line", "text")))
    return merged.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def check_parses(files: DataFrame) -> DataFrame:
    """(file, error) of the files that no longer parse."""
    return files.select("file", parse_error("text").alias("error")).where("error IS NOT NULL")


def unknown_imports(fixes: DataFrame, stub_symbols: DataFrame, package: str) -> DataFrame:
    """(id, name): names of ``package`` that fixed import lines use and the stub does not have.

    A static check: nothing is imported or run.
    """
    imports = fixes.where((F.col("verdict") == "FIX") & strip(F.col("proposed_line")).rlike(rf"^(from|import)\s+{package}\b"))
    names = imports.select("id", F.explode(imports_of(strip(F.col("proposed_line")), F.array().cast("array<string>"))).alias("name"))
    return names.where(F.col("name").startswith(package)).join(stub_symbols.select("name"), "name", "left_anti").select("id", "name")


def same_failures(before: DataFrame, after: DataFrame) -> bool:
    """Whether two test runs (columns test, outcome) fail in the same tests."""
    failed = lambda d: d.where("outcome <> 'passed'").select("test").distinct()
    a, b = failed(before), failed(after)
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()
