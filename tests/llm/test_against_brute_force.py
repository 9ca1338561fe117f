"""Operators on the standard tables against plain Python."""

import collections
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from public_tokenizers import path
from tokenizers import Tokenizer

from tidemark.llm import decontamination, packing, pii, queries, simhash, token_planes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(sf_dir):
    return duckdb.sql(f"SELECT * FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").df()


def run(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).toPandas()


def test_op1_counts_and_junk(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op1_quality_rules").set_index("doc_id")
    junk = 0
    for doc_id, text in zip(docs.doc_id, docs.text):
        words, row = WORD.findall(text), got.loc[doc_id]
        at = collections.defaultdict(list)
        for i in range(len(words) - 2):
            at[tuple(words[i : i + 3])].append(i)
        covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
        )
        assert row.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (row.base_failed and row.kept)
        if not row.base_failed and row.n_symbols > 0.2 * row.word_chars:
            junk += 1
            assert not row.kept
    assert junk and got.kept.mean() > 0.7


def test_op3_held_out_accuracy(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op3_language_id").merge(docs, on="doc_id")
    assert list(got.held_out) == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]
    assert (got.lang == got.lang_pred)[got.held_out].mean() > 0.97
    assert got.score.between(0, 1).all()


def test_op5_base_spans(spark, sf_dir, docs):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    got = run(spark, sf_dir, "op5_personal_data").set_index("doc_id")
    for doc_id, text in zip(docs.doc_id, docs.text):
        spans = [(0, *m.span()) for m in email.finditer(text)]
        spans += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m.group().split("."))]
        spans += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and pii._luhn(digits(m))]
        spans += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
        row = got.loc[doc_id]
        assert row.base_sha256 == pii.sha256_of(spans)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == s[0] for s in spans) for k in range(4)]


@pytest.mark.parametrize("name", ["op4_zip_warc", "op6_decontamination"])
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = run(spark, sf_dir, name)[list(want.columns)]
    rows = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).values.tolist()))
    as_float = lambda d: d.assign(**{c: d[c].astype(float) for c in d.columns if d[c].dtype.kind in "if"})
    assert len(got) and rows(as_float(got)) == rows(as_float(want))


def test_op7_base_and_model(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op7_context_mixing").set_index("doc_id")
    tokens = {d: [w.decode() for w in t.encode().lower().split()] + [""] for d, t in zip(docs.doc_id, docs.text)}
    counts = collections.Counter()
    for d in tokens:
        if zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update(tokens[d])
    n, v = sum(counts.values()), len(counts)
    for d, words in tokens.items():
        row = got.loc[d]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert math.isclose(row.base_score, base, rel_tol=1e-9)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
    # far fewer than eight bits a byte, on texts that were not learned from
    assert got[got.held_out].bits_per_byte.mean() < 3.0


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0])
def test_op6_at_other_thresholds(spark, threshold):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rng.choice(words, n)) for n in (3, 8, 40, 150, 300, 700, 2000)]
    docs, k = [], 0
    for t in texts:
        w = t.split()
        for share in (0.1, 0.25, 0.45, 0.55, 0.79, 0.83, 1.0):
            part = w[: int(len(w) * share)]
            docs += [(k, " ".join([*rng.choice(words, 30), *part, *rng.choice(words, 500)])), (k + 1, " ".join(part))]
            k += 2
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", d.toPandas())
    con.register("benchmark", b.toPandas())
    want = con.execute(queries.ORACLE_SQL["op6_decontamination"].replace(">= 0.8", f">= {threshold}")).fetchall()
    for bound in (200_000, 10):
        got = decontamination.find_contaminated(d, b, threshold, max_broadcast=bound).collect()
        assert sorted(map(tuple, got)) == sorted(want) and len(want) > 10


def test_op8_and_op10_ids(spark, sf_dir, docs):
    want, start = {}, 0
    words = Tokenizer.from_file(path("word_bpe_49k.json"))
    for d, t in zip(docs.doc_id, docs.text):
        ids = np.array(words.encode(t, add_special_tokens=False).ids + [2], "<u4")
        want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = run(spark, sf_dir, "op8_token_planes")
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got.itertuples()} == want

    pieces = run(spark, sf_dir, "op10_packing")
    bytes_ = Tokenizer.from_file(path("byte_bpe_50k.json"))
    of = {d: p.sort_values("start") for d, p in pieces.groupby("doc_id")}
    for d, t in zip(docs.doc_id, docs.text):
        ids, at = np.array(bytes_.encode(t, add_special_tokens=False).ids + [1], "<u4"), 0
        for r in of[d].itertuples():
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    placed = pieces.sort_values(["sequence_id", "offset"])
    group = placed.groupby("sequence_id").length
    assert (group.cumsum() - placed.length == placed.offset).all()
    sizes = group.sum()
    assert sizes.max() <= 2048 and 1 - sizes.sum() / (2048 * len(sizes)) < 0.02


def test_op9_components(spark, sf_dir, docs):
    prints = []
    for text in docs.text:
        words = text.encode().lower().split()
        grams = list(zip(words, words[1:], words[2:])) if len(words) > 2 else [words] if words else []
        hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    prints = np.array(prints, "u8")
    got = run(spark, sf_dir, "op9_simhash").sort_values("doc_id")
    assert list(got.fingerprint) == [f"{p:016x}" for p in prints]
    assert list(got.component_id) == brute_components(list(docs.doc_id), prints)


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[:i]) <= 3):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [ids[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("chunk", [4096, 7])
def test_close_edges_connect_what_is_close(spark, chunk):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    near = [c ^ sum((np.uint64(1) << np.uint64(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)), np.uint64(0)) for c in centres for _ in range(40)]
    prints = np.unique(np.array(near, "u8"))
    frame = spark.createDataFrame([(int(x),) for x in prints.view("i8")], "fp long")
    labels = {r.node: r.root for r in simhash.components(simhash.close_edges(frame, chunk=chunk)).collect()}
    signed = [int(x) for x in prints.view("i8")]
    order = np.argsort(prints.view("i8"))
    want = brute_components([signed[i] for i in order], prints[order])
    assert [labels.get(signed[i], signed[i]) for i in order] == want


def test_fill_window_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(200):
        lengths = rng.integers(1, 40, rng.integers(1, 9)).tolist()
        room = int(rng.integers(1, 90))
        chosen = packing.fill_window(dict(collections.Counter(lengths)), room)
        assert not collections.Counter(chosen) - collections.Counter(lengths)
        best = max(s for s in (sum(x for i, x in enumerate(lengths) if m >> i & 1) for m in range(1 << len(lengths))) if s <= room)
        assert sum(chosen) == best


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    ids = np.random.default_rng(1).integers(0, 1 << 32, 1001, dtype=np.uint32)
    assert (token_planes.from_planes(token_planes.to_planes(ids, kind), len(ids), kind) == ids).all()


@pytest.mark.parametrize("kind,block", [("byte", 8), ("bit", 64)])
def test_plane_files_with_small_blocks(spark, sf_dir, kind, block, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    one = token_planes.read_planes(token_planes.write_planes(docs, f"file://{tmp_path}/a", path("word_bpe_49k.json"), block=block, planes=kind))
    two = token_planes.read_planes(token_planes.write_planes(docs, f"file://{tmp_path}/b", path("word_bpe_49k.json")))
    assert sorted(one.collect()) == sorted(two.collect())
