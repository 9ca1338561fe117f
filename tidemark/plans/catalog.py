"""The corpus operators as queries over the standard tables, each with its SQL.

Documents stand for files, their lines for lines, labels for ground truth, and
a line that two documents share for an import between them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.line_lexer import comment_spans_of
from tidemark.operators import fingerprints, fixes, gram_index, guards, intervals, prefilter, relevance, runs, scan, scoring, usage, verdicts
from tidemark.operators.patterns import Pattern, matches_any
from tidemark.operators.patterns import match_spans as spans_of
from tidemark.sources.tables import shared_dir, table

PATTERNS = (
    Pattern("license", "(?i:license|copyright)"),
    Pattern("email", "[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+"),
    Pattern("secret", 'token = "'),
    Pattern("phone", "[0-9]{3}-[0-9]{3}-[0-9]{4}"),
)
_LICENSE = "(?i:license|copyright)"

# --- Spark side -----------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.lines_of(table(spark, sf_dir, "documents"), "doc_id", "lf")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.candidates_of(table(spark, sf_dir, "documents"), PATTERNS, "doc_id", "lf", unicode=False)


def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "line", F.char_length("text").cast("long").alias("n_chars"))


def scan_match_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)


def scan_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.count_per_pattern(_candidates(spark, sf_dir), PATTERNS).select("pattern", "n")


def scan_match_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = scan.merge_sites(scan.tag_lines(_lines(spark, sf_dir), PATTERNS, "doc_id", unicode=False), "doc_id")
    return tagged.select("doc_id", "line", F.array_join("tags", ",").alias("tags"))


def combined_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(matches_any(F.col("text"), PATTERNS, unicode=False))
    return docs.groupBy("lang").agg(F.count("*").alias("n"))


def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://[^/]*/", "").alias("path"))
    kept = scan.under_prefix(pages, ["en", "fr"], "path")
    return kept.groupBy(F.get(F.split("path", "/"), 1).alias("segment")).agg(F.count("*").alias("n"))


def site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("file"))
    return runs.count_by_folder(pages).withColumnRenamed("folder", "segment")


def yield_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = guards.yield_summary(scan.count_per_pattern(_candidates(spark, sf_dir), PATTERNS))
    return row.select("total", "top_pattern", "top_n", F.round("top_share", 6).alias("top_share"), "ok")


def relevance_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance.direct_relevance(table(spark, sf_dir, "documents"), _LICENSE, "doc_id")


def _shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where(F.char_length("text") > 20).select("doc_id", F.col("text").alias("shared"))


def relevance_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance.closure_through(relevance_direct(spark, sf_dir), _shared_lines(spark, sf_dir), "doc_id", "shared").select("doc_id")


def stage_a_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter.keep_relevant(_candidates(spark, sf_dir), relevance_direct(spark, sf_dir), "doc_id")[0]


def stage_a_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter.keep_relevant(_candidates(spark, sf_dir), relevance_direct(spark, sf_dir), "doc_id")[1]


_ANY = "|".join(f"(?:{p.regex})" for p in PATTERNS)


def _as_files(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col("doc_id").cast("string")).withColumnRenamed("doc_id", "file")


def _by_id(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.col("file").cast("long").alias("doc_id"), *columns)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_files(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _prefiltered(spark: SparkSession, sf_dir: str) -> prefilter.Prefiltered:
    candidates = _as_files(_candidates(spark, sf_dir))
    return prefilter.run_prefilter(candidates, _files(spark, sf_dir), _LICENSE, _ANY, transitive=False, lexer=prefilter.line_lexer("lf"))


def comment_lexer(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "documents").select("doc_id", F.explode(comment_spans_of(F.col("text"), "lf")).alias("s"))
    return spans.select("doc_id", "s.line", "s.c0", "s.c1")


def comment_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = prefilter.lexical_verdicts(_as_files(_candidates(spark, sf_dir)), _files(spark, sf_dir), _ANY, prefilter.line_lexer("lf"))
    return _by_id(judged.withColumn("covered", F.coalesce(F.col("rule") == "comment", F.lit(False))), "line", "covered")


_INNER, _COVERS = "[0-9]+", ("[A-Z][^.!?]*[.!?]", "[(][^()]*[)]", '"[^"]*"')


def span_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    of = lambda regex: docs.select("doc_id", F.explode(spans_of(F.col("text"), regex)).alias("s")).select("doc_id", "s.start", "s.end")
    covers = of(_COVERS[0]).unionByName(of(_COVERS[1])).unionByName(of(_COVERS[2]))
    return intervals.contained_pairs(of(_INNER), covers, ["doc_id"])


def span_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    of = lambda regex: docs.select("doc_id", F.explode(spans_of(F.col("text"), regex)).alias("s")).select("doc_id", "s.start", "s.end")
    marked = intervals.mark_contained(of(_INNER), of(_COVERS[0]).unionByName(of(_COVERS[1])).unionByName(of(_COVERS[2])), ["doc_id"])
    return marked.groupBy("doc_id", "contained").agg(F.count("*").alias("n"))


def collapse_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).withColumnRenamed("text", "snippet")
    reps, _ = prefilter.collapse_duplicates(lines, "doc_id")
    listed = F.array_join(F.coalesce("duplicate_lines", F.array("line")), ",")
    return reps.select("doc_id", "line", F.coalesce("duplicate_count", F.lit(1)).cast("long").alias("n"), listed.alias("lines"))


def expand_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).withColumnRenamed("text", "snippet")
    reps, expansion = prefilter.collapse_duplicates(lines, "doc_id")
    return prefilter.expand_duplicates(reps.select("doc_id", "line", "snippet"), expansion, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("line").alias("line_sum"))


def chunk_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.assign_chunks(_candidates(spark, sf_dir), 40, "doc_id").select("doc_id", "line", "chunk_id")


def chunk_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    licenses = _lines(spark, sf_dir).where(F.col("text").rlike(_LICENSE))
    return verdicts.exact_cover(_candidates(spark, sf_dir), licenses, "doc_id")


def droplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_id(_prefiltered(spark, sf_dir).droplog, "stage", "rule", "line")


def prefilter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = _prefiltered(spark, sf_dir).stats
    return row.select("start", *[F.col(f"after_{s}").alias(f"after_{s.lower()}") for s in "ABC"], F.round("reduction_percent", 6).alias("reduction_percent"))


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, files = _as_files(_candidates(spark, sf_dir)), _files(spark, sf_dir)
    truth = _as_files(_lines(spark, sf_dir).where(F.col("text").rlike("@|[0-9]-[0-9]"))).select("file", "line")
    direct, reached = _as_files(relevance_direct(spark, sf_dir)), _as_files(relevance_transitive(spark, sf_dir))
    found = runs.ablation_table(runs.mark_stages(candidates, files, _ANY, truth, direct, reached, prefilter.line_lexer("lf")))
    return found.withColumn("reduction_percent", F.round("reduction_percent", 6))


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucket per document with candidates: sites of one source never fall below flagged."""
    found = _candidates(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    bucket = F.when(F.col("pattern") == "license", "proposed").when(F.col("pattern") == "email", "flagged").otherwise("rejected")
    return verdicts.apply_floor(found.withColumn("bucket", bucket), F.col("source") == "src0")


def verdict_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("doc_id", "line", "bucket")


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return scoring.match_truth(_routed(spark, sf_dir).select("doc_id", "bucket"), _truth(spark, sf_dir), ["doc_id"]).join(about, "doc_id")


def _rounded(d: DataFrame) -> DataFrame:
    return d.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "surfaced_recall")})


def score_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.score(_matched(spark, sf_dir), empty_precision=1.0))


def score_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.score(_matched(spark, sf_dir), ["lang"], empty_precision=1.0))


def score_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.score_rollup(_matched(spark, sf_dir), ["lang", "source"], empty_precision=1.0))


def fn_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _candidates(spark, sf_dir)
    kept = stage_a_keep(spark, sf_dir)
    return scoring.attribute_losses(_truth(spark, sf_dir), raw, kept, ["doc_id"], _routed(spark, sf_dir).select("doc_id", "bucket")).select("doc_id", "route")


def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scoring.set_counts(docs.where(F.col("text").rlike(_LICENSE)).select("doc_id"), docs.where(F.contains("text", F.lit("@"))).select("doc_id"))


def determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _candidates(spark, sf_dir).select("doc_id", "line")
    two = scan.tag_lines(_lines(spark, sf_dir), PATTERNS, "doc_id", unicode=False).select("doc_id", "line")
    return scoring.symmetric_difference(one, two)


def _patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines after a fix: license lines rewritten, and every line with a phone number twice."""
    lines = _lines(spark, sf_dir)
    text = F.when(F.col("text").rlike(_LICENSE), "SPDX").otherwise(F.col("text"))
    copies = F.when(F.col("text").rlike(PATTERNS[3].regex), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return lines.select("doc_id", "line", text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.differences(_lines(spark, sf_dir), _patched(spark, sf_dir))


#: The vocabulary of a second scan; every match holds a gram.
LATER = (Pattern("rights", "(?i:copyright|all rights)"), Pattern("secret", 'token = "[0-9a-f]+'), Pattern("mail", "[a-z]+@example[.]"))


def _index(spark: SparkSession, sf_dir: str) -> gram_index.GramIndex:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return gram_index.build_index(docs, f"{shared_dir(spark)}/grams-{uuid.uuid4().hex}", "doc_id")


def indexed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram_index.indexed_candidates(table(spark, sf_dir, "documents").select("doc_id", "text"), _index(spark, sf_dir), LATER, "lf", unicode=False)


def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram_index.possible_files(_index(spark, sf_dir), LATER, unicode=False).select("doc_id", "n_bytes")


def verdict_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict document per text with candidates, some of them broken, and what is wrong with each."""
    rows = _candidates(spark, sf_dir)
    line = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.col("line").cast("string").alias("line")))).otherwise(F.to_json(F.struct("line")))
    fields = F.to_json(F.struct(F.col("doc_id").cast("string").alias("file"), "pattern", "snippet", F.when(F.col("pattern") == "phone", " ").otherwise("r").alias("reason")))
    entry = F.concat(F.regexp_replace(fields, "[}]$", ","), F.substring(line, 2, 1 << 20))
    listed = rows.select("doc_id", entry.alias("entry")).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("entry")), ",").alias("entries"))
    rest = F.when(F.col("doc_id") % 5 == 0, '"flag_uncertain": {}').when(F.col("doc_id") % 7 == 0, '"flag_uncertain": [3]').otherwise('"flag_uncertain": []')
    value = F.concat(F.lit('{"proposed_sites": ['), "entries", F.lit("], "), rest, F.lit(', "considered_and_rejected": []'), F.when(F.col("doc_id") % 11 == 0, "").otherwise("}"))
    found = verdicts.document_violations(listed.select(F.col("doc_id").cast("string").alias("path"), value.alias("value")))
    return found.groupBy(F.col("path").cast("long").alias("doc_id"), F.regexp_replace("violation", r"\[\d+\]", "").alias("violation")).agg(F.count("*").alias("n"))


def run_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("role", F.char_length("text").cast("long").alias("n_chars"), "turn")
    return scoring.ranges(turns, ["role"], ["n_chars", "turn"])


def span_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = lambda text: F.regexp_extract_all(text, F.lit("([A-Za-z]+@[a-z0-9.]+|[0-9]{4,})"), F.lit(1))
    row = guards.span_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), quoted)
    return row.select(F.col("guide_spans").alias("n_spans"), F.col("shared").alias("n_shared"))


def token_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.identifier_tokens(F.col("text"))).alias("token")).distinct()
    named = table(spark, sf_dir, "nation").select("n_name").union(table(spark, sf_dir, "part").select("p_name")).toDF("n")
    pairs = guards.covering_pairs(words, named.select(F.lower("n").alias("word")))
    per = words.join(pairs, "token").groupBy(F.col("word").alias("name"))
    return per.agg(F.count("*").alias("n_pairs"), F.count_distinct("item_id").alias("n_items"))


def request_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.request_key(F.col("role"), F.col("text")).alias("request"))


def fix_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    patched = lines.where(F.col("text").rlike(_LICENSE)).select("doc_id", "line", F.lit("FIX").alias("verdict"), F.lit("SPDX").alias("proposed_line"))
    whole = fixes.apply_fixes(lines, patched, "doc_id")
    return whole.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.substring(F.sha2("text", 256), 1, 16).alias("digest"))


def fix_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("role", "text")
    pick = F.char_length("text") % 3
    noisy = F.when(pick == 0, F.concat("text", F.lit("  "))).when(pick == 1, F.concat(F.lit("  "), F.col("text"))).otherwise(F.concat("text", F.lit(" x")))
    return c.withColumn("class", fixes.classify_line(noisy, F.col("text"))).groupBy("class").agg(F.count("*").alias("n"))


def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    size = F.char_length("text").cast("long")
    calls = c.select(F.col("role").alias("model"), size.alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), F.lit(0).cast("long").alias("cache_creation_input_tokens"), F.col("turn").cast("long").alias("cache_read_input_tokens"))
    prices = spark.createDataFrame([("user", 3.0, 15.0, 3.75, 0.3), ("assistant", 15.0, 75.0, 18.75, 1.5)], ["model", *[f"{x}_price" for x in usage.COUNTERS]])
    cost = usage.estimate_cost(usage.total_usage(calls, ["model"]), prices)
    return cost.select("model", "input_tokens", "cache_read_input_tokens", F.round("cost", 6).alias("cost"))


def blank_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.blank_fields(table(spark, sf_dir, "documents"), ["text", "lang", "source"])


def dup_across_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.repeated_sites(scan.tag_lines(_lines(spark, sf_dir), PATTERNS, "doc_id", unicode=False).select("doc_id", "line", F.explode("tags")), "doc_id")


def match_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _candidates(spark, sf_dir).select("doc_id", "line", F.explode(spans_of(F.col("snippet"), _ANY)).alias("m"))
    return found.select("doc_id", "line", F.col("m.start").alias("c0"), F.col("m.end").alias("c1"))


def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    given = F.concat(F.lit(" ./host/"), F.regexp_replace("url", "^https?://", ""))
    return pages.select("page_id", T.normalize_path(given).alias("path"))


def import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = _lines(spark, sf_dir).select(T.is_import_line(F.lower("text")).alias("is_import"), F.col("text").rlike(r"^\s*$").alias("is_blank"))
    return tagged.groupBy("is_import", "is_blank").agg(F.count("*").alias("n"))


def non_breaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    fact = F.when(F.col("turn") % 2 == 0, F.concat(F.col("text"), F.lit(" This is NOT BREAKING."))).otherwise(F.col("text"))
    return c.select("role", T.is_non_breaking(fact).alias("skip")).groupBy("role", "skip").agg(F.count("*").alias("n"))


# --- SQL side -------------------------------------------------------------

_SQL_LINES = """
  raw AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
  cut AS (SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM raw),
  lines AS (SELECT doc_id, unnest(generate_series(1, len(parts))) AS line, unnest(parts) AS text FROM cut)"""
_SQL_HITS = (
    _SQL_LINES
    + """,
  cand AS (
    SELECT doc_id, line, text AS snippet, CASE
      WHEN regexp_matches(text, '(?i:license|copyright)') THEN 'license'
      WHEN regexp_matches(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+') THEN 'email'
      WHEN regexp_matches(text, 'token = "') THEN 'secret'
      WHEN regexp_matches(text, '[0-9]{3}-[0-9]{3}-[0-9]{4}') THEN 'phone' END AS pattern
    FROM lines),
  hits AS (SELECT * FROM cand WHERE pattern IS NOT NULL),
  rel AS (SELECT DISTINCT doc_id FROM documents WHERE regexp_matches(text, '(?i:license|copyright)'))"""
)
_SQL_ANY = """'(?i:license|copyright)|[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+|token = "|[0-9]{3}-[0-9]{3}-[0-9]{4}'"""
_SQL_LEXER = r""",
  marks AS (SELECT * FROM (VALUES (0, ''), (1, repeat(chr(39), 3)), (2, repeat('"', 3)), (3, chr(39)), (4, '"')) AS v(s, mark)),
  masked AS (SELECT doc_id, line, regexp_replace(text, '(?s)\\.', chr(1) || chr(1), 'g') AS t FROM lines),
  entered AS (SELECT doc_id, line, s, mark, t, CASE WHEN s = 0 THEN t WHEN strpos(t, mark) > 0 THEN substr(t, strpos(t, mark) + length(mark)) END AS rest FROM masked, marks),
  tokens AS (SELECT *, regexp_extract_all(rest, concat('(?s)', repeat(chr(39), 3), '.*?(?:', repeat(chr(39), 3), '|\z)|', repeat('"', 3), '.*?(?:', repeat('"', 3), '|\z)|', chr(39), '[^', chr(39), ']*(?:', chr(39), '|\z)|"[^"]*(?:"|\z)|#.*'))[-1] AS last FROM entered),
  opened AS (SELECT tokens.*, coalesce(m.s, 0) AS o, length(m.mark) AS k FROM tokens LEFT JOIN marks m ON m.s = CASE WHEN starts_with(last, repeat(chr(39), 3)) THEN 1 WHEN starts_with(last, repeat('"', 3)) THEN 2 WHEN starts_with(last, chr(39)) THEN 3 WHEN starts_with(last, '"') THEN 4 END),
  moves AS (SELECT doc_id, line, s, length(t) AS n, CASE WHEN starts_with(last, '#') THEN length(last) END AS c,
      CASE WHEN rest IS NULL THEN CASE WHEN s < 3 OR ends_with(t, '\') THEN s ELSE 5 END WHEN o = 0 THEN 0
      WHEN length(last) >= 2 * k AND ends_with(last, CASE o WHEN 1 THEN repeat(chr(39), 3) WHEN 2 THEN repeat('"', 3) WHEN 3 THEN chr(39) ELSE '"' END) THEN 0
      WHEN o < 3 OR ends_with(last, '\') THEN o ELSE 5 END AS e FROM opened),
  states AS (SELECT doc_id, 1 AS line, 0 AS s FROM cut UNION ALL SELECT states.doc_id, states.line + 1, e FROM states JOIN moves USING (doc_id, line, s)),
  whole AS (SELECT states.doc_id FROM states JOIN cut USING (doc_id) WHERE line = len(parts) + 1 AND s = 0),
  comments AS (SELECT doc_id, line, (n - c)::INT AS c0, n::INT AS c1 FROM states JOIN moves USING (doc_id, line, s) WHERE c IS NOT NULL AND doc_id IN (SELECT doc_id FROM whole))"""
_SQL_SPANS = f""",
  p AS (SELECT doc_id, line, regexp_extract_all(snippet, {_SQL_ANY}) AS m, regexp_split_to_array(snippet, {_SQL_ANY}) AS g FROM hits),
  s AS (SELECT doc_id, line, unnest(list_transform(generate_series(1, len(m)), lambda i: {{'c0': length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i-1], '')), 'n': length(m[i])}})) AS s FROM p)"""
_SQL_COVER = f"""{_SQL_LEXER}{_SQL_SPANS},
  inside AS (SELECT doc_id, line, bool_and(EXISTS (SELECT 1 FROM comments c WHERE c.doc_id = s.doc_id AND c.line = s.line AND c.c0 <= s.s.c0 AND s.s.c0 + s.s.n <= c.c1)) AS covered FROM s GROUP BY doc_id, line),
  cov AS (SELECT hits.*, coalesce(covered, false) AS covered, doc_id IN (SELECT doc_id FROM rel) AS a, regexp_replace(regexp_replace(snippet, '^\\s+', ''), '\\s+$', '') AS body FROM hits LEFT JOIN inside USING (doc_id, line))"""
_SQL_DOC_SPANS = """
  re AS (SELECT * FROM (VALUES (0, '[0-9]+'), (1, '[A-Z][^.!?]*[.!?]'), (2, '[(][^()]*[)]'), (3, '"[^"]*"')) AS v(kind, re)),
  m AS (SELECT doc_id, kind, regexp_extract_all(text, re) AS m, regexp_split_to_array(text, re) AS g FROM documents, re WHERE text IS NOT NULL),
  u AS (SELECT doc_id, kind, unnest(m) AS m, unnest(g[1:len(m)]) AS g, unnest(range(1, len(m) + 1)) AS i FROM m),
  e AS (SELECT DISTINCT doc_id, kind > 0 AS outer_, (sum(length(m) + length(g)) OVER (PARTITION BY doc_id, kind ORDER BY i) - length(m))::BIGINT AS start, (sum(length(m) + length(g)) OVER (PARTITION BY doc_id, kind ORDER BY i))::BIGINT AS "end" FROM u),
  i AS (SELECT * FROM e WHERE NOT outer_), o AS (SELECT * FROM e WHERE outer_)"""
_SQL_ROUTE = """,
  routed AS (
    SELECT doc_id, line, lang, d.source, CASE pattern WHEN 'license' THEN 'proposed' WHEN 'email' THEN 'flagged' ELSE CASE WHEN d.source = 'src0' THEN 'flagged' ELSE 'rejected' END END AS bucket
    FROM hits JOIN documents d USING (doc_id)),
  truth AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
  best AS (SELECT doc_id, CASE min(CASE bucket WHEN 'proposed' THEN 0 WHEN 'flagged' THEN 1 ELSE 2 END) WHEN 0 THEN 'proposed' WHEN 1 THEN 'flagged' ELSE 'rejected' END AS bucket FROM routed GROUP BY doc_id),
  matched AS (
    SELECT doc_id, coalesce(bucket, 'invisible') AS bucket, truth.doc_id IS NOT NULL AS is_true, d.lang, d.source
    FROM best FULL JOIN truth USING (doc_id) JOIN documents d USING (doc_id))"""
_SQL_SCORES = """
  count(*) FILTER (bucket = 'proposed' AND is_true) AS tp, count(*) FILTER (bucket = 'proposed' AND NOT is_true) AS fp,
  count(*) FILTER (is_true AND bucket <> 'proposed') AS fn, count(*) FILTER (is_true AND bucket = 'flagged') AS fn_flagged,
  count(*) FILTER (is_true AND bucket = 'rejected') AS fn_rejected, count(*) FILTER (is_true AND bucket = 'invisible') AS fn_invisible,
  round(coalesce(count(*) FILTER (bucket = 'proposed' AND is_true) / nullif(count(*) FILTER (bucket = 'proposed'), 0)::DOUBLE, 1.0), 6) AS precision,
  round(coalesce(count(*) FILTER (bucket = 'proposed' AND is_true) / nullif(count(*) FILTER (is_true), 0)::DOUBLE, 1.0), 6) AS recall,
  round(coalesce(count(*) FILTER (bucket IN ('proposed', 'flagged') AND is_true) / nullif(count(*) FILTER (is_true), 0)::DOUBLE, 1.0), 6) AS surfaced_recall"""
_SQL_NAMES = "(VALUES (0, 'license'), (1, 'email'), (2, 'secret'), (3, 'phone')) AS p(ord, pattern)"


@dataclass(frozen=True)
class Query:
    """A query and its SQL, if it has one."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ALL = [
    Query(line_scan, f"WITH {_SQL_LINES} SELECT doc_id, line, length(text) AS n_chars FROM lines"),
    Query(scan_match_first, f"WITH {_SQL_HITS} SELECT doc_id, line, snippet, pattern FROM hits"),
    Query(scan_match_count, f"WITH {_SQL_HITS} SELECT p.pattern, count(hits.doc_id) AS n FROM {_SQL_NAMES} LEFT JOIN hits USING (pattern) GROUP BY p.pattern"),
    Query(
        scan_match_tags,
        f"""WITH {_SQL_LINES}, t AS (SELECT doc_id, line, concat_ws(',', CASE WHEN regexp_matches(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+') THEN 'email' END,
        CASE WHEN regexp_matches(text, '(?i:license|copyright)') THEN 'license' END, CASE WHEN regexp_matches(text, '[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}') THEN 'phone' END,
        CASE WHEN regexp_matches(text, 'token = "') THEN 'secret' END) AS tags FROM lines) SELECT * FROM t WHERE tags <> ''""",
    ),
    Query(
        combined_match,
        """SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(text, '(?i:license|copyright)|[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+|token = "|[0-9]{3}-[0-9]{3}-[0-9]{4}') GROUP BY lang""",
    ),
    Query(
        prefix_scan,
        """WITH p AS (SELECT regexp_replace(url, '^https?://[^/]*/', '') AS path FROM pages), q AS (SELECT unnest(['en', 'fr']) AS pre)
        SELECT string_split(path, '/')[2] AS segment, count(*) AS n FROM p WHERE EXISTS (SELECT 1 FROM q WHERE path = pre OR starts_with(path, pre || '/')) GROUP BY 1""",
    ),
    Query(site_counts, "SELECT string_split(regexp_replace(url, '^https?://', ''), '/')[1] AS segment, count(*) AS n FROM pages GROUP BY 1"),
    Query(
        yield_guard,
        f"""WITH {_SQL_HITS}, c AS (SELECT p.ord, p.pattern, count(hits.doc_id) AS n FROM {_SQL_NAMES} LEFT JOIN hits USING (pattern) GROUP BY ALL),
        t AS (SELECT sum(n)::BIGINT AS total FROM c), top AS (SELECT pattern, n FROM c ORDER BY n DESC, ord LIMIT 1)
        SELECT total, pattern AS top_pattern, n AS top_n, round(CASE WHEN total > 0 THEN n / total::DOUBLE ELSE 0 END, 6) AS top_share,
        NOT (total > 2000 OR (n >= 25 AND total > 0 AND n / total::DOUBLE >= 0.35)) AS ok FROM t, top""",
    ),
    Query(relevance_direct, "SELECT DISTINCT doc_id FROM documents WHERE regexp_matches(text, '(?i:license|copyright)')"),
    Query(
        relevance_transitive,
        f"""WITH RECURSIVE {_SQL_HITS}, m AS (SELECT DISTINCT doc_id, text AS shared FROM lines WHERE length(text) > 20),
        r AS (SELECT doc_id FROM rel UNION SELECT b.doc_id FROM r JOIN m a ON a.doc_id = r.doc_id JOIN m b ON b.shared = a.shared) SELECT doc_id FROM r""",
    ),
    Query(stage_a_keep, f"WITH {_SQL_HITS} SELECT doc_id, line, snippet, pattern FROM hits WHERE doc_id IN (SELECT doc_id FROM rel)"),
    Query(stage_a_drop, f"WITH {_SQL_HITS} SELECT doc_id, line, snippet, pattern FROM hits WHERE doc_id NOT IN (SELECT doc_id FROM rel)"),
    Query(comment_lexer, f"WITH RECURSIVE {_SQL_LINES}{_SQL_LEXER} SELECT doc_id, line, c0, c1 FROM comments"),
    Query(comment_cover, f"WITH RECURSIVE {_SQL_HITS}{_SQL_COVER} SELECT doc_id, line, covered FROM cov"),
    Query(
        span_containment,
        f"""WITH {_SQL_DOC_SPANS} SELECT DISTINCT i.doc_id, i.start, i."end", o.start AS cover_start, o."end" AS cover_end FROM i JOIN o ON o.doc_id = i.doc_id AND o.start <= i.start AND i."end" <= o."end" """,
    ),
    Query(
        span_marks,
        f"""WITH {_SQL_DOC_SPANS}, t AS (SELECT doc_id, EXISTS (SELECT 1 FROM o WHERE o.doc_id = i.doc_id AND o.start <= i.start AND i."end" <= o."end") AS contained FROM i) SELECT doc_id, contained, count(*) AS n FROM t GROUP BY 1, 2""",
    ),
    Query(
        collapse_duplicates,
        f"""WITH {_SQL_LINES} SELECT doc_id, min(line) AS line, count(*) AS n, string_agg(line::VARCHAR, ',' ORDER BY line) AS lines
        FROM lines GROUP BY doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')""",
    ),
    Query(expand_duplicates, f"WITH {_SQL_LINES} SELECT doc_id, count(*) AS n, sum(line)::BIGINT AS line_sum FROM lines GROUP BY doc_id"),
    Query(chunk_assign, f"WITH {_SQL_HITS} SELECT doc_id, line, ((row_number() OVER (ORDER BY doc_id, line) - 1) // 40)::INT AS chunk_id FROM hits"),
    Query(
        chunk_cover,
        f"""WITH {_SQL_HITS}, g AS (SELECT doc_id, line FROM lines WHERE regexp_matches(text, '(?i:license|copyright)'))
        SELECT count(*) FILTER (g.doc_id IS NULL) AS missing, count(*) FILTER (hits.doc_id IS NULL) AS unexpected, 0::BIGINT AS repeated FROM hits FULL JOIN g USING (doc_id, line)""",
    ),
    Query(
        droplog,
        f"""WITH RECURSIVE {_SQL_HITS}{_SQL_COVER}, kept AS (SELECT *, min(line) OVER (PARTITION BY doc_id, body) AS first FROM cov WHERE a AND NOT covered)
        SELECT 'A' AS stage, 'file_relevance' AS rule, doc_id, line FROM cov WHERE NOT a UNION ALL SELECT 'B', 'comment', doc_id, line FROM cov WHERE covered AND a
        UNION ALL SELECT 'C', 'collapsed_duplicate', doc_id, line FROM kept WHERE line <> first""",
    ),
    Query(
        prefilter_stats,
        f"""WITH RECURSIVE {_SQL_HITS}{_SQL_COVER},
        n AS (SELECT count(*) AS start, count(*) FILTER (a) AS after_a, count(*) FILTER (a AND NOT covered) AS after_b, count(DISTINCT (doc_id, body)) FILTER (a AND NOT covered) AS after_c FROM cov)
        SELECT start, after_a, after_b, after_c, round((1 - after_c / start::DOUBLE) * 100, 6) AS reduction_percent FROM n""",
    ),
    Query(
        ablation,
        f"""WITH RECURSIVE {_SQL_HITS}{_SQL_COVER}, mm AS (SELECT DISTINCT doc_id, text AS shared FROM lines WHERE length(text) > 20),
        r AS (SELECT doc_id FROM rel UNION SELECT b.doc_id FROM r JOIN mm a ON a.doc_id = r.doc_id JOIN mm b ON b.shared = a.shared),
        t AS (SELECT DISTINCT doc_id, line, true AS is_true FROM lines WHERE regexp_matches(text, '@|[0-9]-[0-9]')),
        x AS (SELECT cov.*, doc_id IN (SELECT doc_id FROM r) AS far, coalesce(is_true, false) AS is_true FROM cov LEFT JOIN t USING (doc_id, line)),
        c AS (SELECT * FROM (VALUES ('A', false), ('AB', false), ('ABC', false), ('A', true), ('AB', true), ('ABC', true)) AS v(stages, transitive)),
        k AS (SELECT c.stages, c.transitive, x.* FROM c JOIN x ON CASE WHEN c.transitive THEN far ELSE a END AND (c.stages = 'A' OR NOT covered)),
        n AS (SELECT stages, transitive, CASE WHEN stages = 'ABC' THEN count(DISTINCT (doc_id, body)) ELSE count(*) END AS final, count(*) FILTER (is_true) AS truth_kept FROM k GROUP BY 1, 2)
        SELECT c.stages, c.transitive, (SELECT count(*) FROM hits) AS start, coalesce(final, 0) AS final, round((1 - coalesce(final, 0) / (SELECT count(*) FROM hits)::DOUBLE) * 100, 6) AS reduction_percent, coalesce(truth_kept, 0) AS truth_kept
        FROM c LEFT JOIN n USING (stages, transitive)""",
    ),
    Query(verdict_route, f"WITH {_SQL_HITS}{_SQL_ROUTE} SELECT doc_id, line, bucket FROM routed"),
    Query(score_overall, f"WITH {_SQL_HITS}{_SQL_ROUTE} SELECT {_SQL_SCORES} FROM matched"),
    Query(score_by_class, f"WITH {_SQL_HITS}{_SQL_ROUTE} SELECT lang, {_SQL_SCORES} FROM matched GROUP BY lang"),
    Query(score_rollup, f"WITH {_SQL_HITS}{_SQL_ROUTE} SELECT lang, source, {_SQL_SCORES} FROM matched GROUP BY ROLLUP (lang, source)"),
    Query(
        fn_route,
        f"""WITH {_SQL_HITS}{_SQL_ROUTE} SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM hits) THEN CASE WHEN doc_id IN (SELECT doc_id FROM rel) THEN best.bucket ELSE 'prefilter_dropped' END ELSE 'scan_missed' END AS route FROM truth LEFT JOIN best USING (doc_id)""",
    ),
    Query(
        set_ops,
        """WITH a AS (SELECT DISTINCT doc_id FROM documents WHERE regexp_matches(text, '(?i:license|copyright)')), b AS (SELECT DISTINCT doc_id FROM documents WHERE contains(text, '@'))
        SELECT 'both' AS op, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
        UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""",
    ),
    Query(
        determinism,
        f"""WITH {_SQL_HITS}, a AS (SELECT doc_id, line FROM hits), b AS (SELECT doc_id, line FROM lines WHERE regexp_matches(text, {_SQL_ANY}))
        SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) + (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS n_different""",
    ),
    Query(
        snapshot_diff,
        f"""WITH {_SQL_LINES}, p AS (SELECT doc_id, line, CASE WHEN regexp_matches(text, '(?i:license|copyright)') THEN 'SPDX' ELSE text END AS text, unnest(CASE WHEN regexp_matches(text, '[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}') THEN [1, 2] ELSE [1] END) AS copy FROM lines),
        d AS (SELECT 'first' AS side, * FROM (SELECT doc_id, line, text FROM lines EXCEPT ALL SELECT doc_id, line, text FROM p) UNION ALL SELECT 'second', * FROM (SELECT doc_id, line, text FROM p EXCEPT ALL SELECT doc_id, line, text FROM lines))
        SELECT side, doc_id, line, text, count(*) AS n FROM d GROUP BY ALL""",
    ),
    Query(
        indexed_scan,
        f"""WITH {_SQL_LINES}, t AS (SELECT doc_id, line, text AS snippet, CASE WHEN regexp_matches(text, '(?i:copyright|all rights)') THEN 'rights' WHEN regexp_matches(text, 'token = "[0-9a-f]+') THEN 'secret'
        WHEN regexp_matches(text, '[a-z]+@example[.]') THEN 'mail' END AS pattern FROM lines) SELECT * FROM t WHERE pattern IS NOT NULL""",
    ),
    Query(
        index_files,
        """SELECT doc_id, strlen(text) AS n_bytes FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        WHERE len(list_filter(['cop', 'opy', 'pyr', 'yri', 'rig', 'igh', 'ght'], lambda g: contains(t, g))) = 7 OR len(list_filter(['all', 'll ', 'l r', ' ri', 'rig', 'igh', 'ght', 'hts'], lambda g: contains(t, g))) = 8
        OR len(list_filter(['tok', 'oke', 'ken', 'en ', 'n =', ' = ', '= "'], lambda g: contains(t, g))) = 7 OR len(list_filter(['@ex', 'exa', 'xam', 'amp', 'mpl', 'ple', 'le.'], lambda g: contains(t, g))) = 7""",
    ),
    Query(
        verdict_documents,
        f"""WITH {_SQL_HITS}, d AS (SELECT DISTINCT doc_id FROM hits), v AS (
        SELECT doc_id, 'not JSON' AS violation FROM d WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id, 'proposed_sites: line is not an integer' FROM hits WHERE doc_id % 11 <> 0 AND doc_id % 3 = 0
        UNION ALL SELECT doc_id, 'proposed_sites: blank reason' FROM hits WHERE doc_id % 11 <> 0 AND pattern = 'phone' UNION ALL SELECT doc_id, 'flag_uncertain: missing or not a list' FROM d WHERE doc_id % 11 <> 0 AND doc_id % 5 = 0
        UNION ALL SELECT doc_id, 'flag_uncertain: not an object' FROM d WHERE doc_id % 11 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 = 0) SELECT doc_id, violation, count(*) AS n FROM v GROUP BY ALL""",
    ),
    Query(run_ranges, "SELECT role, min(length(text)) AS min_n_chars, max(length(text)) AS max_n_chars, min(turn) AS min_turn, max(turn) AS max_turn FROM conversations GROUP BY role"),
    Query(
        span_extract,
        """WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(text, '([A-Za-z]+@[a-z0-9.]+|[0-9]{4,})', 1)) AS span FROM documents),
        b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '([A-Za-z]+@[a-z0-9.]+|[0-9]{4,})', 1)) AS span FROM benchmark)
        SELECT count(*) AS n_spans, count(b.span) AS n_shared FROM d LEFT JOIN b USING (span)""",
    ),
    Query(
        token_theta,
        """WITH w AS (SELECT DISTINCT item_id, lower(t) AS token FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) AS t FROM benchmark) WHERE length(t) >= 2),
        n AS (SELECT lower(n_name) AS name FROM nation UNION SELECT lower(p_name) FROM part)
        SELECT name, count(*) AS n_pairs, count(DISTINCT item_id) AS n_items FROM w JOIN n ON contains(replace(token, '_', ''), replace(name, '_', '')) OR contains(replace(name, '_', ''), replace(token, '_', '')) GROUP BY name""",
    ),
    Query(request_key, "SELECT conv_id, turn, substr(sha256(role || chr(0) || text), 1, 24) AS request FROM conversations"),
    Query(
        fix_apply,
        f"""WITH {_SQL_LINES}, t AS (SELECT doc_id, string_agg(CASE WHEN regexp_matches(text, '(?i:license|copyright)') THEN 'SPDX' ELSE text END, chr(10) ORDER BY line) AS text FROM lines GROUP BY doc_id)
        SELECT doc_id, length(text) AS n_chars, substr(sha256(text), 1, 16) AS digest FROM t""",
    ),
    Query(
        fix_classify,
        r"""WITH t AS (SELECT text, CASE length(text) % 3 WHEN 0 THEN text || '  ' WHEN 1 THEN '  ' || text ELSE text || ' x' END AS noisy FROM conversations)
        SELECT CASE WHEN regexp_replace(noisy, '\s+$', '') = regexp_replace(text, '\s+$', '') THEN 'exact'
        WHEN regexp_replace(trim(noisy), '\s+', ' ', 'g') = regexp_replace(trim(text), '\s+', ' ', 'g') THEN 'semantic' ELSE 'wrong' END AS class, count(*) AS n FROM t GROUP BY 1""",
    ),
    Query(
        usage_cost,
        """WITH u AS (SELECT role AS model, sum(length(text))::BIGINT AS input_tokens, count(*) AS output_tokens, sum(turn)::BIGINT AS cache_read_input_tokens FROM conversations GROUP BY role),
        p AS (SELECT * FROM (VALUES ('user', 3.0::DOUBLE, 15.0::DOUBLE, 0.3::DOUBLE), ('assistant', 15.0, 75.0, 1.5)) AS v(model, pi, po, pr))
        SELECT u.model, input_tokens, cache_read_input_tokens, round(input_tokens / 1e6 * pi + output_tokens / 1e6 * po + cache_read_input_tokens / 1e6 * pr, 6) AS cost FROM u LEFT JOIN p USING (model)""",
    ),
    Query(
        blank_validation,
        r"""SELECT 'text' AS "column", count(*) FILTER (text IS NULL OR regexp_full_match(text, '\s*')) AS n FROM documents UNION ALL
        SELECT 'lang', count(*) FILTER (lang IS NULL OR regexp_full_match(lang, '\s*')) FROM documents UNION ALL
        SELECT 'source', count(*) FILTER (source IS NULL OR regexp_full_match(source, '\s*')) FROM documents""",
    ),
    Query(
        dup_across_buckets,
        f"""WITH {_SQL_LINES}, t AS (SELECT (regexp_matches(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+'))::INT + (regexp_matches(text, '(?i:license|copyright)'))::INT
        + (regexp_matches(text, '[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}'))::INT + (regexp_matches(text, 'token = "'))::INT AS k FROM lines) SELECT coalesce(sum(k - 1), 0)::BIGINT AS n_repeated FROM t WHERE k > 0""",
    ),
    Query(match_spans, f"WITH {_SQL_HITS}{_SQL_SPANS} SELECT doc_id, line, s.s.c0 AS c0, s.s.c0 + s.s.n AS c1 FROM s"),
    Query(path_normalize, "SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages"),
    Query(import_lines, f"WITH {_SQL_LINES} SELECT regexp_matches(lower(text), '^\\s*(from|import)\\s') AS is_import, regexp_matches(text, '^\\s*$') AS is_blank, count(*) AS n FROM lines GROUP BY 1, 2"),
    Query(
        non_breaking,
        """WITH t AS (SELECT role, lower(CASE WHEN turn % 2 = 0 THEN text || ' This is NOT BREAKING.' ELSE text END) AS f FROM conversations)
        SELECT role, len(list_filter(['out of scope', 'not a breaking change', 'confirmed unchanged', 'not breaking', 'unaffected by', 'does not change', 'no change needed'], lambda m: contains(f, m))) > 0 AS skip, count(*) AS n FROM t GROUP BY 1, 2""",
    ),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.run.__name__: q.run for q in ALL}
ORACLE_SQL: dict[str, str] = {q.run.__name__: q.sql for q in ALL if q.sql}
