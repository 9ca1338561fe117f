"""Verdicts on a closed list of candidates: chunks, coverage, validation, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.source_code import stand_in_lines_of
from tidemark.functions.text import is_blank
from tidemark.sources.tables import stage

BUCKETS = {"proposed_sites": "proposed", "flag_uncertain": "flagged", "considered_and_rejected": "rejected"}
VERDICTS = "bucket string, file string, line int, pattern string, snippet string, reason string"


class VerdictError(ValueError):
    """Verdicts that break the contract."""


def assign_chunks(candidates: DataFrame, size: int = 40, key: str = "file") -> DataFrame:
    """Add chunk_id: runs of ``size`` in (key, line) order.

    Rows are sorted by range and numbered within each range in a written table;
    only one count per range is added up in order.
    """
    ranges = candidates.repartitionByRange(key, "line").sortWithinPartitions(key, "line", *[c for c in candidates.columns if c not in (key, "line")])
    rows = stage(ranges.withColumn("_at", F.monotonically_increasing_id()), "chunk-rows")
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = rows.join(offsets, part == F.col("_part"))
    at = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("chunk_id", F.floor(at / size).cast("int")).drop("_at", "_part", "_before")


def rechunk(verdicts: DataFrame, chunks: DataFrame, key: str = "file") -> DataFrame:
    """Verdicts of an earlier run under the chunks of a new one; a site without a verdict is an error."""
    found = chunks.select("chunk_id", key, "line").join(verdicts.drop("chunk_id"), [key, "line"], "left")
    missing = found.where("bucket IS NULL").select(key, "line").limit(5).collect()
    if missing:
        raise VerdictError("no verdict for " + ", ".join(f"{r[0]}:{r[1]}" for r in missing))
    return found.select("chunk_id", *[c for c in verdicts.columns if c != "chunk_id"])


def exact_cover(expected: DataFrame, given: DataFrame, key: str = "file") -> DataFrame:
    """One row: missing, unexpected and repeated sites of ``given`` against ``expected`` (key, line)."""
    left = expected.select(key, "line").distinct().withColumn("e", F.lit(1))
    right = given.groupBy(key, "line").agg(F.count("*").alias("g"))
    both = left.join(right, [key, "line"], "full_outer")
    return both.agg(
        F.count_if(F.col("g").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"), F.coalesce(F.sum(F.col("g") - 1), F.lit(0)).alias("repeated")
    )


def require_cover(expected: DataFrame, given: DataFrame, key: str = "file") -> None:
    """Raise unless every expected site has exactly one verdict and no other site has any."""
    row = exact_cover(expected, given, key).first()
    if row.missing or row.unexpected or row.repeated:
        raise VerdictError(f"{row.missing} sites without verdict, {row.unexpected} not asked for, {row.repeated} repeated")


def violations(raw: dict) -> list[str]:
    """What is wrong with one verdict document, before any cast could hide it."""
    found = []
    if not isinstance(raw, dict):
        return ["not an object"]
    for bucket in BUCKETS:
        rows = raw.get(bucket)
        if not isinstance(rows, list):
            found.append(f"{bucket}: missing or not a list")
            continue
        needed = ["file", "reason", *(["pattern", "snippet"] if bucket == "proposed_sites" else [])]
        for i, row in enumerate(rows):
            if not isinstance(row, dict):
                found.append(f"{bucket}[{i}]: not an object")
                continue
            if type(row.get("line")) is not int:
                found.append(f"{bucket}[{i}]: line is not an integer")
            found += [f"{bucket}[{i}]: blank {k}" for k in needed if not isinstance(row.get(k), str) or not row[k].strip()]
    return found


def _kind(value: Column) -> Column:
    """The type of a variant value by name; null for a missing one."""
    return F.schema_of_variant(value)


def _field(row: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(row, f"$.{name}", kind)


def _is_blank_text(value: Column) -> Column:
    """Whether a variant is no text, or a blank one."""
    text = value.cast("string")
    return F.coalesce(_kind(value) != "STRING", F.lit(True)) | F.coalesce(text.rlike(r"(?U)^[\s\x1c-\x1f]*$"), F.lit(True))


def _is_whole(value: Column) -> Column:
    return F.coalesce((_kind(value) == "BIGINT") | _kind(value).rlike(r"^DECIMAL\(\d+,0\)$"), F.lit(False))


def _exploded(documents: DataFrame) -> DataFrame:
    """(path, doc, bucket, k, i, row): the entries of all buckets; row is null where a bucket is missing or no list."""
    parts = []
    for k, bucket in enumerate(BUCKETS):
        rows = documents.select("path", "doc", F.lit(bucket).alias("bucket"), F.lit(k).alias("k"), _field(F.col("doc"), bucket, "array<variant>").alias("rows"))
        # an empty list has no entry; a missing one has an entry without a place
        marked = F.when(F.col("rows").isNull(), F.array(F.struct(F.lit(None).cast("int").alias("i"), F.lit(None).cast("variant").alias("row"))))
        entries = marked.otherwise(F.transform("rows", lambda r, i: F.struct(i.alias("i"), r.alias("row"))))
        parts.append(rows.select("path", "doc", "bucket", "k", F.explode(entries).alias("e")).select("path", "doc", "bucket", "k", "e.i", "e.row"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def parsed(raw: DataFrame) -> DataFrame:
    """(path, value) with ``doc``, the text as a variant; null where it is no JSON."""
    return raw.withColumn("doc", F.try_parse_json("value"))


def document_violations(raw: DataFrame, run_files: bool = False) -> DataFrame:
    """(path, place, violation): what is wrong with verdict documents (path, value), as :func:`violations` says it.

    Types are read from the parsed variant before any cast, which would turn a
    text into a number and a missing key into a null.  Nothing leaves the JVM.
    """
    docs = parsed(raw)
    say = lambda rows, place, text: rows.select("path", place.cast("long").alias("place"), text.alias("violation"))
    whole = F.coalesce(_kind(F.col("doc")).startswith("OBJECT"), F.lit(False))
    found = say(docs.where(F.col("doc").isNull()), F.lit(-1), F.lit("not JSON")).unionByName(say(docs.where(F.col("doc").isNotNull() & ~whole), F.lit(-1), F.lit("not an object")))
    entries = _exploded(docs.where(whole))
    at = F.concat("bucket", F.lit("["), F.col("i").cast("string"), F.lit("]: "))
    place = F.col("k") * (1 << 40) + F.coalesce("i", F.lit(0)) * 8
    row = F.col("row")
    is_object = F.coalesce(_kind(row).startswith("OBJECT"), F.lit(False))
    checks = [(F.col("i").isNull(), F.concat("bucket", F.lit(": missing or not a list"))), (F.col("i").isNotNull() & ~is_object, F.concat(at, F.lit("not an object"))), (is_object & ~_is_whole(_field(row, "line")), F.concat(at, F.lit("line is not an integer")))]
    checks += [(is_object & _is_blank_text(_field(row, name)) & (F.lit(name in ("file", "reason")) | (F.col("k") == 0)), F.concat(at, F.lit(f"blank {name}"))) for name in ("file", "reason", "pattern", "snippet")]
    messages = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(n).alias("n"), text.alias("violation"))) for n, (test, text) in enumerate(checks)]))
    found = found.unionByName(entries.select("path", place.alias("place"), F.explode(messages).alias("m")).select("path", (F.col("place") + F.col("m.n")).alias("place"), "m.violation"))
    if run_files:
        about = [(_is_blank_text(_field(F.col("doc"), name)), F.lit(f"blank {name}")) for name in ("target", "repo")] + [(~_is_whole(_field(F.col("doc"), "run")), F.lit("run is not an integer"))]
        for n, (test, text) in enumerate(about):
            found = found.unionByName(say(docs.where(whole & test), F.lit((1 << 50) + n), text))
    return found


def document_rows(raw: DataFrame) -> DataFrame:
    """(path, target, repo, run, and the verdict columns) of valid documents (path, value)."""
    rows = _exploded(parsed(raw)).where("i IS NOT NULL")
    named = F.create_map(*[F.lit(x) for pair in BUCKETS.items() for x in pair])
    about = [_field(F.col("doc"), name, kind).alias(name) for name, kind in (("target", "string"), ("repo", "string"), ("run", "int"))]
    text = lambda name: _field(F.col("row"), name, "string").alias(name)
    return rows.select("path", *about, named[F.col("bucket")].alias("bucket"), text("file"), _field(F.col("row"), "line", "int").alias("line"), text("pattern"), text("snippet"), text("reason"))


def read_verdicts(spark: SparkSession, paths: str | list[str], run_files: bool = False) -> DataFrame:
    """Verdict documents (JSON files) as one long table; any violation in any of them is an error.

    With ``run_files`` every document also has target, repo and an integer run.
    """
    raw = spark.read.format("binaryFile").load(paths)
    # Spark lists empty files but gives no row for them
    listed, read = len(raw.inputFiles()), raw.count()
    if not listed or read < listed:
        raise VerdictError(f"{listed} verdict files, {listed - read} of them empty")
    files = raw.select("path", F.decode("content", "UTF-8").alias("value"))
    bad = document_violations(files, run_files).orderBy("path", "place").limit(20).collect()
    if bad:
        raise VerdictError("; ".join(f"{r.path}: {r.violation}" for r in bad))
    return document_rows(files)


def blank_fields(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n): how many rows are null or blank in each of ``columns``."""
    counts = rows.agg(*[F.count_if(is_blank(F.col(c))).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])).alias("r")).select("r.*")


def to_document(verdicts: DataFrame) -> dict[str, list[dict]]:
    """A merged verdict document, ordered by site; for reports, so of a bounded list."""
    out: dict[str, list[dict]] = {k: [] for k in BUCKETS}
    keys = {v: k for k, v in BUCKETS.items()}
    for r in verdicts.select("bucket", "file", "line", "pattern", "snippet", "reason").orderBy("file", "line").collect():
        fields = r.asDict()
        out[keys[fields.pop("bucket")]].append({k: v for k, v in fields.items() if v is not None})
    return out


def is_test_path(path: Column) -> Column:
    """Test and mock files: the floor below which no reject may stand."""
    return path.rlike(r"(^|/)tests/|(^|/)test_[^/]*\.py$|_test\.py$|(?i:mock|fixture)")


def impersonates(snippet: Column) -> Column:
    """Lines that register or build a module object under another name."""
    return snippet.rlike(r"sys\.modules\s*\[|types\.ModuleType\s*\(")


def stand_ins(files: DataFrame, key: str = "file") -> DataFrame:
    """(key, line): lines that put a name on a module object built in the same file, the third form of impersonation."""
    risky = files.where(F.col("text").rlike(r"ModuleType|sys\.modules"))
    return risky.select(key, F.explode(stand_in_lines_of("text")).alias("line")).distinct()


def apply_floor(verdicts: DataFrame, floor: Column) -> DataFrame:
    """Rejected rows where ``floor`` holds are flagged instead."""
    return verdicts.withColumn("bucket", F.when((F.col("bucket") == "rejected") & F.coalesce(floor, F.lit(False)), "flagged").otherwise(F.col("bucket")))


def split_hedged(verdicts: DataFrame, hedge_regex: str) -> DataFrame:
    """Rejected rows whose reason hedges are flagged instead."""
    return apply_floor(verdicts, F.col("reason").rlike(f"(?i){hedge_regex}"))


def repeated_sites(verdicts: DataFrame, key: str = "file") -> DataFrame:
    """One row: verdict rows beyond the first of each site."""
    return verdicts.agg((F.count("*") - F.count_distinct(F.struct(key, "line"))).alias("n_repeated"))
