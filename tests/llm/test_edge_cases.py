"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import time

import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

from tidemark.llm import context_mixing, decontamination, exact_dedup, language_id, packing, pii, quality_classifier, quality_rules, simhash, token_alignment, token_planes, zip_warc
from tidemark.llm.common import fresh_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `DOC` string, n_words string, kept string, h string, fp string, score string, word string, uid string, grp string, _w string"
LONG = "lorem ipsum dolor sit amet " * 12_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (2, None, None, None),
    (3, "", "en", None),
    (4, " \t\n\u000b ", None, "a"),
    (5, LONG, "la", "b"),
    (None, "a b", "en", "b"),
    (6, "über straße schön", "de", "a"),
    (7, "x" * 70_000, "en", "a"),
    (8, "a\0b cd \0 nul <|endoftext|> end", "en", "a"),
    (9, "1234567890" * 100_000 + " 10.0.0.1", "en", "a"),
]
OPERATORS = {
    "rules": lambda s, d: quality_rules.apply_quality_rules(d),
    "classifier": lambda s, d: quality_classifier.classify(d, s.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int"), F.col("source"), F.col("lang")),
    "language": lambda s, d: language_id.identify_held_out(d),
    "pii": lambda s, d: pii.span_report(d),
    "mixing": lambda s, d: context_mixing.score_documents(d),
    "planes": lambda s, d: token_planes.read_planes(token_planes.write_planes(d, fresh_dir(s, "t"), path("word_bpe_49k.json"))),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "alignment": lambda s, d: token_alignment.link_report(d, path("byte_bpe_50k.json"), path("piece_bpe_32k.model")),
    "exact": lambda s, d: exact_dedup.find_duplicates(d),
    "packing": lambda s, d: packing.pack_documents(d, path("byte_bpe_50k.json")).select("doc_id", "start").where("start = 0"),
}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, *["clash"] * 10) for r in rows], SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_give_one_row_each(spark, name):
    got = OPERATORS[name](spark, frame(spark, ROWS)).collect()
    key = lambda x: (x is None, x)
    assert sorted((r.doc_id for r in got), key=key) == sorted((r[0] for r in ROWS), key=key)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_gives_no_rows(spark, name):
    assert OPERATORS[name](spark, frame(spark, [])).collect() == []


def test_values_on_hostile_texts(spark):
    docs = frame(spark, ROWS)
    spans = {r.doc_id: r for r in pii.span_report(docs).collect()}
    assert (spans[9].n_ip, spans[9].n_card, spans[9].spans.split(",")[0]) == (1, 0, "ip:1000001:1000009")
    languages = {r.doc_id: r for r in language_id.identify_held_out(docs).collect()}
    assert languages[2].lang_pred == languages[3].lang_pred == languages[4].lang_pred == languages[9].lang_pred == "und"
    assert languages[8].lang_pred != "und" and 0 <= languages[8].score <= 1
    rules = {r.doc_id: r for r in quality_rules.apply_quality_rules(docs).collect()}
    assert (rules[8].n_words, rules[8].n_symbols, rules[8].word_chars) == (6, 4, 25) and rules[8].base_failed and not rules[8].kept
    assert (rules[5].n_words, rules[5].n_repeat_words, rules[5].base_failed) == (60_000, 60_000, True)
    scores = {r.doc_id: r for r in context_mixing.score_documents(docs).collect()}
    assert scores[2].n_tokens == scores[3].n_tokens == scores[4].n_tokens == 1 and scores[8].n_tokens == 7
    prints = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert prints[2].fingerprint == prints[4].fingerprint == "0" * 16 and prints[3].component_id == 2
    ids = {r.doc_id: r for r in token_planes.read_planes(token_planes.write_planes(docs, fresh_dir(spark, "t"), path("word_bpe_49k.json"))).collect()}
    assert ids[2].n_tokens == ids[3].n_tokens == ids[4].n_tokens == 1 and ids[None].start == 0
    pieces = [r for r in packing.pack_documents(docs, path("byte_bpe_50k.json")).collect() if r.doc_id == 5]
    assert sum(r.length for r in pieces) == pieces[0].doc_tokens and len({r.start for r in pieces}) == len(pieces)


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "quick brown fox jumps over the lazy"), (4, "quick brown fox jumps over the lazy"), (None, "ipsum dolor sit amet lorem ipsum")], "item_id long, text string").withColumn("h", F.lit("clash"))
    got = sorted((str(r.doc_id), str(r.item_id), r.containment) for r in decontamination.find_contaminated(frame(spark, ROWS), items).collect())
    assert got == sorted([("None", "1", 1.0), ("5", "None", 1.0), *[("1", "4", 1.0)] * 4])
    assert decontamination.find_contaminated(frame(spark, []), items).collect() == []
    assert decontamination.find_contaminated(frame(spark, ROWS), items.limit(0)).collect() == []


def test_packages_edges(spark):
    schema = "page_id long, url string, html string, digest string, refers_to string"
    big, rows = "ä" * 800, []
    for page_id, html in ((1, big), (2, big), (2, big), (None, big), (3, None), (4, ""), (5, "short"), (6, "short"), (7, "y" * 200_000)):
        rows.append((page_id, None if page_id == 5 else "http://e.org/\r\nx", html, "clash", "clash"))
    got = zip_warc.archive_pages(spark.createDataFrame(rows, schema), fresh_dir(spark, "t")).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got) == sorted(
        [("1", 1600, "revisit", 2), ("2", 1600, "response", None), ("2", 1600, "response", None), ("None", 1600, "revisit", 2), ("3", 0, "response", None), ("4", 0, "response", None)]
        + [("5", 5, "response", None), ("6", 5, "response", None), ("7", 200_000, "response", None)],
        key=str,
    )
    assert zip_warc.archive_pages(spark.createDataFrame([], schema), fresh_dir(spark, "t")).collect() == []


def test_long_texts_of_numbers_come_in_parts(spark):
    """A column of numbers of two megabytes: linear time, parts of bounded size, and the same spans as a short text."""
    rng = random.Random(2)
    numbers = " ".join(str(rng.randrange(10**9, 10**10)) for _ in range(180_000))
    known = "call +1 555 201 4000 now, " * 3
    rows = [(1, known + "call 5552014000 now " + numbers + " bob@example.org end 10.0.0.1"), (2, known), (3, " ".join(["12"] * 3000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    parts = pii.scan(docs, block=1 << 12).groupBy("doc_id").agg(F.count("*").alias("parts"), F.max(F.size("occ")).alias("most"), F.sum(F.size("occ")).alias("n"), F.sum(F.size("base")).alias("base")).collect()
    assert time.time() - began < 60
    got = {r.doc_id: r for r in parts}
    assert max(r.most for r in parts) <= 1 << 12 and got[1].parts > 40 and got[2].parts == 1
    assert got[1].n >= 180_000 and (got[1].base, got[2].base, got[3].base) == (5, 3, 0)
    report = {r.doc_id: r for r in pii.span_report(docs).collect()}
    assert (report[1].n_phone, report[1].n_email, report[1].n_ip, report[2].n_phone) == (3, 1, 1, 3)
    spans = [s.split(":") for s in report[1].spans.split(",")]
    assert all(rows[0][1][int(a) : int(b)].strip() for _, a, b in spans)
    # of one run, every start has the sub-runs of up to 19 digits
    assert got[3].n == sum(min(9, 3000 - i) for i in range(3000)) + 1


@pytest.mark.parametrize("n", [0, 1, 50])
def test_chosen_spans_do_not_overlap(n):
    rng = random.Random(n)
    marked = [(rng.choice([0.8, 0.9, 1.0]), rng.randrange(4), a, a + rng.randrange(1, 9)) for a in (rng.randrange(100) for _ in range(n))]
    kept = pii.chosen(marked, [(a, b) for *_, a, b in marked])
    assert all(x[2] <= y[1] for x, y in zip(kept, kept[1:]))
    if marked:
        best = min(marked, key=lambda m: (-m[0], m[2] - m[3], m[2], m[1]))
        assert best[1:] in kept
