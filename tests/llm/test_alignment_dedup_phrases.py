"""Token alignment, exact duplicates and phrases against plain Python, and on hostile rows."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import exact_dedup, phrases, queries, token_alignment
from tidemark.llm.common import stage
from tidemark.llm.tokenizer import CachedEncoder, byte_letters

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, row long, digest string, keep string, prefix string, seg string, pair string, n string, word string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, -1, *["clash"] * 7) for r in rows], SCHEMA)


# --- alignment --------------------------------------------------------------


def plain_groups(ends_a, ends_b):
    common = np.intersect1d(ends_a, ends_b)
    return np.searchsorted(ends_a, common) + 1, np.searchsorted(ends_b, common) + 1


def test_run_skipping_finds_the_common_ends():
    chance = random.Random(5)
    for n in [*range(1, 40), 500, 5000]:
        for share in (0.0, 0.02, 0.5, 0.98, 1.0):
            whole = sorted(chance.sample(range(1, 4 * n + 1), n))
            cut = lambda: np.array(sorted({*(x for x in whole if chance.random() >= share), *(chance.randrange(1, whole[-1] + 1) for _ in range(int(n * share))), whole[-1]}))
            a, b = cut(), cut()
            for got, want in zip(token_alignment.group_ends(a, b), plain_groups(a, b)):
                assert got.tolist() == want.tolist()


class Plain:
    """Both tokenizers without caches."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        letters = {c: b for b, c in byte_letters().items()}
        self.bytes_a = lambda i: bytes(letters[c] for c in self.a.id_to_token(i))
        self.bytes_b = lambda i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() if (p := self.b.id_to_piece(i)) else b""

    def piece_b(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        parts_a, parts_b = [self.bytes_a(i) for i in a], [self.piece_b(i) for i in b]
        if not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            return []
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))] if len(parts) < 50 else np.cumsum([len(p) for p in parts]).tolist()
        ends_a, ends_b = ends(parts_a), ends(parts_b)
        out, last = [], [0, 0]
        for x in sorted(set(ends_a) & set(ends_b)):
            now = [ends_a.index(x) + 1, ends_b.index(x) + 1] if len(ends_a) < 50 else [int(np.searchsorted(ends_a, x)) + 1, int(np.searchsorted(ends_b, x)) + 1]
            out.append((a[last[0] : now[0]], b[last[1] : now[1]]))
            last = now
        return out


def plain_report(texts):
    plain = Plain()
    groups = [plain.groups(t) for t in texts]
    held = collections.Counter()
    for g in groups:
        held.update({(x, y) for a, b in g for x in a for y in b})
    best = collections.Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    rows = []
    for g in groups:
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        rows.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return rows


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    None, "", " ", "  two  spaces ", "a\tb\n\nc\n", "\n", "<|endoftext|> in a text", "</s><unk>", "naïve café – “quoted” …", "日本語のテキスト、全部で。", "👩‍👩‍👧 emoji ﬁ ligature",
    "aaaaaaaa" * 3000, "x", "x", "the the the", "12345678901234567890 3.14159", "a\0b", "don't we'll it's", "é combining", "　wide space", "tab\tend\t",
]


@pytest.mark.parametrize("in_memory", [0, 8, 1 << 20])
def test_links_of_odd_texts(spark, in_memory):
    rows = [(i, t, "en") for i, t in enumerate(ODD)] + [(None, "the the the", "en")]
    got = {r.doc_id: tuple(r[c] for c in FIELDS) for r in token_alignment.link_report(frame(spark, rows), A, B, in_memory).collect()}
    want = plain_report([r[1] for r in rows])
    for (doc_id, text, _), expected in zip(rows, want):
        assert got[doc_id] == expected, text
    assert len(got) == len(rows)


def test_links_of_the_standard_documents(spark, sf_dir):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()
    got = {r.doc_id: tuple(r[c] for c in FIELDS) for r in queries.op11_token_alignment(spark, sf_dir).collect()}
    assert [got[d] for d, _ in docs] == plain_report([t for _, t in docs])


def test_pairs_in_several_blocks(spark, monkeypatch):
    texts = [t for t in ODD if t] + ["one two three four five"] * 2
    rows = [[i, i, 0, 0, 0, 0, "", None] for i in range(len(texts))]
    pair = token_alignment.Pair(A, B)
    tokens = pair.encode(texts)
    a, b = (np.concatenate([t[k] for t in tokens]) for k in (0, 1))
    # every document is one group here, so all its ids are linked
    group_a, group_b = (np.repeat(np.arange(len(texts)), [len(t[k]) for t in tokens]) for k in (0, 1))
    want = [collections.Counter((int(x) * pair.width + int(y)) for x in t[0].tolist() for y in t[1].tolist()) if len(t[0]) < 3000 else None for t in tokens]
    monkeypatch.setattr(token_alignment, "BLOCK_PAIRS", 300)
    keep = [i for i, w in enumerate(want) if w is not None]
    some_a, some_b = np.isin(group_a, keep), np.isin(group_b, keep)
    extra = token_alignment._fill_pairs(rows, a[some_a], b[some_b], group_a[some_a], group_b[some_b], np.arange(len(texts)), pair.width)
    assert extra
    found = collections.defaultdict(list)
    for r in [*rows, *extra]:
        if r[7] is not None:
            found[r[0]] += [*zip(*(x.tolist() for x in token_alignment.unpack_pairs(r[7])))]
    for i in keep:
        assert sorted(found[i]) == sorted(want[i].items())


def test_alignment_interface(spark):
    got = token_alignment.align_documents(frame(spark, [(1, "hello aligned world", "en"), (2, None, None)]), A, B).orderBy("doc_id").collect()
    assert got[0].ends_a[-1] == len(got[0].ids_a) and got[0].ends_b[-1] == len(got[0].ids_b) and len(got[0].ends_a) == len(got[0].ends_b)
    assert got[1].ids_a == got[1].ends_b == []
    assert token_alignment.link_report(frame(spark, []), A, B).collect() == []


def test_plain_encoder_after_a_space():
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    encoder = CachedEncoder(A, plain=True)
    for text in filter(None, ODD):
        assert np.frombuffer(encoder.encode_after_space(text), "<u4").tolist() == tokenizer.encode(" " + text, add_special_tokens=False).ids, text


# --- exact duplicates ---------------------------------------------------------


def plain_duplicates(rows):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = collections.defaultdict(list)
    for r in rows:
        groups[low(r[1])].append(r[0])
    out = []
    for r in rows:
        ids = [i for i in groups[low(r[1])] if i is not None]
        out.append((r[0], max(ids, default=None), len(groups[low(r[1])]), hashlib.sha256(low(r[1]).encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=str)


DUPLICATES = [(1, "Same TEXT", "en"), (5, "same text", "de"), (5, "same text", "de"), (3, "SAME text", None), (7, None, None), (8, "", "en"), (None, "x", "en"), (None, "X", "en"), (9, "ÄB", "de"), (10, "äB", "de"), (11, "long " * 200_000, "en"), (12, "LONG " * 200_000, "en"), (None, "same text", "en")]


@pytest.mark.parametrize("k", [1, 2, 5, 2048])
def test_exact_duplicates_whatever_the_split(spark, k):
    rows = DUPLICATES * 3 + [(100 + i, f"Heavy {i % 2}", "en") for i in range(40)]
    found = exact_dedup.find_duplicates(frame(spark, rows).repartition(5), k).collect()
    assert order((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == order(plain_duplicates(rows))
    stays = collections.Counter(r.text_sha256 for r in found if r.kept)
    assert set(stays.values()) == {1} and len(stays) == len({r.text_sha256 for r in found})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_summaries_find_every_heavy_digest(spark):
    rows = [(bytes([i % 7]) if i % 3 else i.to_bytes(4, "big"),) for i in range(9000)]
    digests = stage(spark.createDataFrame(rows, "digest binary").repartition(4), "d")
    found = {bytes(r.digest): r.at_least for r in exact_dedup.frequent_digests(digests, 40).collect()}
    counts = collections.Counter(r[0] for r in rows)
    assert {d for d, n in counts.items() if n * 40 > 3 * len(rows)} <= set(found) and len(found) <= 41
    assert all(counts[d] - 2 * len(rows) / 40 <= n <= counts[d] for d, n in found.items())


def test_distinct_documents_keep_their_columns(spark):
    docs = frame(spark, DUPLICATES)
    left = exact_dedup.distinct_documents(docs)
    assert left.columns == docs.columns and left.count() == len({d[3] for d in plain_duplicates(DUPLICATES)})
    assert exact_dedup.find_duplicates(frame(spark, [])).collect() == [] and exact_dedup.distinct_documents(frame(spark, [])).collect() == []


# --- phrases --------------------------------------------------------------------


def plain_phrases(rows, least, top):
    import re

    counts, sizes = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            sizes[lang] += len(w)
            counts.update((lang, *w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    cand = {g: a for g, a in counts.items() if len(g) > 2 and a >= least}
    gone = {(g[0], *g[i:j]) for g, f in cand.items() for i in range(1, len(g)) for j in range(i + 2, len(g) + 1) if j - i < len(g) - 1 and 100 * f >= 80 * counts[g[0], *g[i:j]]}
    out = collections.defaultdict(list)
    for g, a in cand.items():
        if g in gone:
            continue
        cuts = [(2_000_000 * a // (l + r), k, l, r) for k in range(1, len(g) - 1) for l, r in [(counts[g[: k + 1]], counts[(g[0], *g[k + 1 :])])]]
        score, _, left, right = min(cuts)
        out[g[0]].append((-score, -a, " ".join(g[1:]).encode(), a, left, right))
    return {(lang, i + 1, p.decode(), a, x, y, sizes[lang], -s) for lang, found in out.items() for i, (s, _, p, a, x, y) in enumerate(sorted(found)[:top])}


def found_phrases(docs, least, top=2000):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(docs, least, top).collect()}


def phrase_rows():
    chance = random.Random(3)
    words = ["the", "of", "a", "über", "x\x01y", "z\0", "Q", "q", "–", "new", "york"]
    rows = [(i, " ".join(chance.choice(words) for _ in range(60)) + chance.choice([".", ",", "\n", "\t\t "]) + "new york city hall", chance.choice(["en", "de", None, ""])) for i in range(80)]
    return rows + [(1, None, "en"), (2, "", None), (3, " .,; \t\n", "fr"), (4, "a " * 5000, "en"), (4, "a " * 5000, "en")]


@pytest.mark.parametrize("shares", [1024, 2])
def test_phrases_equal_plain_counts(spark, monkeypatch, shares):
    monkeypatch.setattr(phrases, "SHARES", shares)
    rows = phrase_rows()
    docs = frame(spark, rows).repartition(4)
    assert found_phrases(docs, 5) == plain_phrases(rows, 5, 2000)
    assert found_phrases(docs, 5, 3) == plain_phrases(rows, 5, 3)


def test_hot_stripes_are_split(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARES", 64)
    rows = phrases.mine_stripes(frame(spark, phrase_rows()), 5).rows
    assert rows.where("seg > 0").count() > 0
    assert rows.groupBy("lang", "prefix", "seg").count().where("count > 1").count() == 0


def test_a_text_longer_than_a_step_is_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "STEP_BYTES", 64)
    text = ("alpha beta gamma. delta epsilon " * 30) + "no break here " * 30 + "; end of it. fin"
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([text, None, "x y"]), pa.array(["en", "en", "de"])], ["text", "lang"])
    pairs = collections.Counter()
    for lang, w in phrases._steps(iter([batch])):
        names = w.names.to_pylist()
        pairs.update((lang, names[a], names[b]) for a, b, j in zip(w.codes, w.codes[1:], w.joined) if j)
    import re

    want = collections.Counter((lang, a, b) for lang, t in (("en", text), ("de", "x y")) for p in re.split("[.,;:!?\n-\r]", t) for w in [p.split()] for a, b in zip(w, w[1:]))
    assert pairs == want


def test_no_documents_have_no_phrases(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(frame(spark, [(1, None, None), (2, "a b", "en")])).collect() == []


def test_exact_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([("en", "a", -1, 3 * 10**17, ["b"], [3 * 10**17])], phrases.MERGED)
    words = spark.createDataFrame([("en", "a", 4 * 10**17), ("en", "b", 3 * 10**17 + 1)], "lang string, word string, n long")
    stripes = phrases.Stripes(rows, words, spark.createDataFrame([("en", 10**18)], "lang string, n long"))
    row = phrases.score_cuts(stripes).first()
    assert row.score == 2_000_000 * 3 * 10**17 // (7 * 10**17 + 1)
    assert phrases.subsumed(stripes).collect() == []


def test_top_of_a_language_over_all_parts(spark):
    rows = spark.range(5000).select(F.lit("en").alias("lang"), F.col("id").cast("string").alias("phrase"), (F.col("id") % 7).alias("score"), (F.col("id") % 3).alias("a"))
    got = [(r["rank"], r.phrase) for r in phrases.first_of_each(rows, 50).orderBy("rank").collect()]
    want = sorted(range(5000), key=lambda i: (-(i % 7), -(i % 3), str(i).encode()))[:50]
    assert got == [(k + 1, str(i)) for k, i in enumerate(want)]
