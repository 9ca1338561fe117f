"""Parts of the operators on small inputs made for them."""

import collections
import io
import random
import re
import struct
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import language_id, pii, quality_classifier, quality_rules, zip_warc
from tidemark.llm.tokenizer import CachedEncoder

ENCODERS = {name: (CachedEncoder(path(name)), Tokenizer.from_file(path(name))) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}
TEXT = st.text(alphabet=st.one_of(st.sampled_from(list("aAzZ .,'\n\t ́éßΣσ09-s　|")), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.mark.parametrize("name", ENCODERS)
@given(text=TEXT)
@settings(max_examples=300, deadline=None)
def test_cached_ids_are_the_tokenizers(name, text):
    cached, plain = ENCODERS[name]
    assert np.frombuffer(cached.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_emails_are_the_leftmost_matches():
    pattern, rng = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice("ab.@-_ 1%") for _ in range(rng.randint(0, 25)))
        assert pii._emails(text) == [m.span() for m in pattern.finditer(text)]


def test_bootstrapping_finds_what_no_base_pattern_matches(spark):
    known = [(i, f"please write to contact user{i}@mail{i}.example.com today") for i in range(30)]
    known += [(100 + i, f"please call phone number +1 (555) {200 + i}-{4000 + i} today") for i in range(30)]
    unseen = [(200, "please write to contact admin@intranet today"), (201, "please call phone number 555-867-5309 today"), (202, "in the year some 19991231 things happened")]
    rows = spark.createDataFrame([*known, *unseen], "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.n_added) for r in pii.span_report(rows).collect()}
    assert got[200] == ("email:24:38", 1)
    assert got[201] == ("phone:25:37", 1)
    assert got[202] == ("", 0)
    assert sorted(pii.mask_documents(rows).collect()) == sorted(pii.mask_documents(rows, max_broadcast=0).collect())
    clash = rows.withColumns({"_row": F.lit("a"), "_spans": F.lit("b"), "uid": F.lit("c")})
    assert sorted(pii.mask_documents(clash).collect()) == sorted(pii.mask_documents(clash, max_broadcast=0).collect())
    masked = {r.doc_id: r.text for r in pii.mask_documents(rows).collect()}
    assert masked[200] == "please write to contact <EMAIL> today" and masked[201] == "please call phone number <PHONE> today"
    assert masked[202] == unseen[2][1] and "@" not in masked[3]


def test_neighbouring_identifiers_are_found_singly(spark):
    cards = "7536784127813050 4845168114407329"
    rows = [(i, f"please call phone number +1 (555) {200 + i}-{4000 + i} today") for i in range(30)]
    rows += [(50, "paid by 4845168114407329 now"), (51, f"numbers {cards} follow"), (52, "reach +1 555 201 4000 soon")]
    rows += [(60, "please call phone number +1 555 201 4000 555-867-5309 today"), (61, "please call phone number 5551 today"), (62, "please call phone number ext-55x today")]
    column = " ".join(f"555-867-{5000 + k}" for k in range(12))
    rows += [(63, f"please call phone number {column} today"), (64, "write bob@example.org 555-1234 or 12 of 345")]
    text = dict(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [text[r.doc_id][s.start : s.end] for s in r.spans] for r in pii.find_personal_data(docs).collect()}
    assert got[51] == ["4845168114407329"] and got[50] == ["4845168114407329"]
    assert got[60] == ["+1 555 201 4000", "555-867-5309"]
    assert got[61] == ["5551"] and got[62] == ["ext-55x"] and got[63] == [column] and got[64] == ["bob@example.org"]
    assert sorted(pii.mask_documents(docs).collect()) == sorted(pii.mask_documents(docs, max_broadcast=0).collect())


def test_candidates_lie_outside_base_spans():
    text = "a 12 34 bob@x.org,56 7 8 9 10 11 12 13 k:14"
    found = [text[a:b] for a, b, kind, *_ in pii.occurrences(text, pii.base_spans(text)) if kind < 0]
    assert {"12", "34", "12 34", "56", "7 8", "8 9 10 11 12 13", "56 7 8 9 10 11 12 13", "14"} <= set(found)
    assert not any("@" in f for f in found) and "56 7 8 9 10 11 12" in found
    # no more than 19 digits, but for the whole run
    run = " ".join(f"{i}0" for i in range(10, 18))
    found = {run[a:b] for a, b, *_ in pii.occurrences(run, [])}
    assert found == {" ".join(run.split()[i:j]) for i in range(8) for j in range(i + 1, 9) if j - i <= 6 or j - i == 8}


def test_mixed_languages_are_split_into_spans(spark):
    en, de, ru = "the house and the garden with some water ", "das haus und der garten mit etwas wasser ", "дом и сад с водой для всех людей "
    train = spark.createDataFrame([(i, t * 3, lang) for i in range(40) for t, lang in ((en, "en"), (de, "de"), (ru, "ru"))], "doc_id long, text string, lang string")
    model = language_id.learn(train)
    assert model.languages == ["de", "en", "ru"]
    rows = spark.createDataFrame([(1, en * 4 + de * 2), (2, ru + en), (3, "123 456 !!"), (4, None), (5, "garten")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(rows, model).collect()}
    assert [(s.first, s.last, s.lang) for s in got[1].spans] == [(0, 31, "en"), (32, 47, "de")] and got[1].lang_pred == "en"
    assert [s.lang for s in got[2].spans] == ["ru", "en"]
    assert got[3].lang_pred == got[4].lang_pred == "und" and got[3].score == 0
    assert got[5].lang_pred == "de"


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = rng.integers(0, 6, 4)
        emissions = rng.normal(size=(9, 3)) * 3
        words = rng.integers(0, 9, sizes.sum())
        labels, at = language_id.viterbi(emissions, words, sizes, 1.5), 0
        for n in sizes:
            mine = emissions[words[at : at + n]]
            cost = lambda p: sum(mine[i][k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
            paths = [[]]
            for _ in range(n):
                paths = [[*p, k] for p in paths for k in range(3)]
            assert np.isclose(cost(labels[at : at + n].tolist()), max(map(cost, paths)))
            at += n


def test_zip_directories(tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.txt", b"hello")
        z.writestr("b.txt", b"PK\5\6 inside")
        z.comment = b"a comment with PK\5\6 in it" + b"\0" * 18
        with z.open(zipfile.ZipInfo("wide.bin"), "w", force_zip64=True) as f:
            f.write(b"x" * 100)
        z.writestr(zipfile.ZipInfo("squeezed"), b"y" * 100, zipfile.ZIP_DEFLATED)
    raw = data.getvalue()
    reader = zip_warc.ZipReader(lambda at, n: raw[at : at + n], len(raw))
    assert reader.stored("a.txt", 1, 3) == b"ell" and reader.stored("b.txt") == b"PK\5\6 inside" and reader.stored("wide.bin", 90) == b"x" * 10
    with pytest.raises(ValueError):
        reader.stored("squeezed")
    # the same archive with a ZIP64 directory, as one beyond 4 GiB has it
    at = raw.rfind(b"PK\5\6", 0, raw.rfind(b"a comment"))
    count, length, start = struct.unpack("<HII", raw[at + 10 : at + 20])
    end64 = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, start)
    wide = raw[:at] + end64 + b"PK\6\7" + struct.pack("<IQI", 0, at, 1) + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert zip_warc.ZipReader(lambda at, n: wide[at : at + n], len(wide)).stored("a.txt") == b"hello"


def test_sparse_sites_shrink_and_dense_ones_speak(spark):
    good, bad = "a fine and careful text about rivers", "%%% buy $$$ now &&& click ### here"
    rows = [(i, good if i % 2 else bad, "h" + str(i % 2), "p") for i in range(400)] + [(1000, "some neutral words", "h1", "p"), (1001, "some neutral words", "h0", "p"), (1002, "some neutral words", "new", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels, F.col("host"), F.col("path")).collect()}
    assert got[1].kept and not got[0].kept
    assert got[1000].path_score > 0.9 > got[1002].path_score > 0.1 > got[1001].path_score


def test_quality_verdicts_do_not_switch_with_a_sites_size(spark):
    def text(rng, lines, symbols):
        return "\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) + "#" * (rng.random() < symbols) for _ in range(9)) for _ in range(lines))

    rng = random.Random(4)
    hot = [(i, text(rng, rng.randint(7, 12), 0.02), "en", "hot") for i in range(400)]
    sparse = [(1000 + i, text(rng, rng.randint(20, 60), 0.9), "en", "sparse") for i in range(101)]

    def distances(n):
        docs = spark.createDataFrame(hot + sparse[:n] + [(5000, "short", "en", "new"), (5001, text(random.Random(1), 9, 0.02), "en", "new")], "doc_id long, text string, lang string, source string")
        return {r.doc_id: (r.distance2, r.kept) for r in quality_rules.apply_quality_rules(docs).collect()}

    few, more, tiny = distances(99), distances(101), distances(5)
    shared = [i for i in few if 1000 <= i < 5000]
    assert [few[i][1] for i in shared] == [more[i][1] for i in shared]
    assert all(abs(few[i][0] - more[i][0]) < 0.1 * more[i][0] + 0.5 for i in shared)
    # the site's own few rows already speak
    assert np.mean([tiny[i][0] for i in range(1000, 1005)]) > np.mean([few[i][0] for i in range(1000, 1005)])
    assert few[5000] == (None, False) and few[5001][1]


def test_the_cache_forgets_but_ids_stay():
    cached, plain = CachedEncoder(path("byte_bpe_50k.json"), max_entries=3), ENCODERS["byte_bpe_50k.json"][1]
    text = "one two three four.\nfive one <|endoftext|> two three,\nfour six one seven"
    for _ in range(3):
        assert np.frombuffer(cached.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(cached) <= 3 and len(cached.old) <= 3
    cached.clear()
    assert not cached and not cached.old
    assert 50256 in plain.encode(text, add_special_tokens=False).ids


def test_addresses_are_the_leftmost_matches():
    pattern, rng = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("12..5 a") for _ in range(rng.randint(0, 25)))
        assert [m.span() for m in pii._IP.finditer(text)] == [m.span() for m in pattern.finditer(text)]


def test_words_may_hold_any_character():
    words = ["a\0b", "cd", "", "\0", "İstanbul", "x\0"]
    bucket, word, letters, masks = language_id.word_features(words, 1 << 16)
    assert letters.tolist()[:4] == [2, 2, 0, 0] and set(word.tolist()) == {0, 1, 4, 5}
    alone = language_id.word_features(["cd"], 1 << 16)
    assert bucket[word == 1].tolist() == alone[0].tolist() and masks[1] == alone[3][0]


def mcd_by_hand(x, floor, share, steps):
    """Centre and covariance as the operator defines them, with exact order statistics."""
    rank = lambda v, p: np.sort(v)[max(0, int(np.ceil(p * len(v))) - 1)]
    distances = lambda m, c: ((x - m) @ np.linalg.inv(c) * (x - m)).sum(1)
    moments = lambda y: (y.mean(0), np.cov(y.T, bias=True))
    median = np.array([rank(v, 0.5) for v in x.T])
    mad = np.array([rank(np.abs(v - m), 0.5) for v, m in zip(x.T, median)])
    found = []
    for m, c in ((median, np.diag((1.4826 * mad) ** 2)), moments(x)):
        for _ in range(steps):
            d = distances(m, c + floor)
            m, c = moments(x[d <= rank(d, share)])
        found.append((np.linalg.slogdet(c + floor)[1], m, c))
    _, m, c = min(found, key=lambda f: f[0])
    d = distances(m, c + floor)
    m, c = moments(x[d <= quality_rules.CHI2_975 * max(rank(d, 0.5) / quality_rules.CHI2_HALF, 1e-9)])
    return m, c * quality_rules.CORE_FACTOR


def test_robust_estimates_are_those_of_numpy(spark):
    rng, names = np.random.default_rng(3), list(quality_rules.FEATURES)
    groups = {}
    for g, n in (("a", 60), ("b", 200), ("c", 7)):
        x = rng.normal(size=(n, 5)) @ rng.normal(size=(5, 5)) + rng.normal(size=5)
        x[: n // 8] += 25  # outliers that pull the plain moments
        groups[g] = x
    rows = spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], ["grp", *names])
    got = {r.grp: r for r in quality_rules.robust_estimates(rows).collect()}
    floor = np.diag(np.array(list(quality_rules.FEATURES.values())) ** 2)
    for g, x in groups.items():
        m, c = mcd_by_hand(x, floor, 0.75, 3)
        assert got[g].n == len(x)
        assert np.allclose([got[g][f"fm{i}"] for i in range(5)], m, rtol=1e-6)
        assert np.allclose([got[g][f"fc{i}_{j}"] for i in range(5) for j in range(i + 1)], [c[i, j] for i in range(5) for j in range(i + 1)], rtol=1e-6, atol=1e-9)
    assert abs(got["b"].fm0 - groups["b"][25:, 0].mean()) < abs(groups["b"][:, 0].mean() - groups["b"][25:, 0].mean()) / 5


def plain_personal_data(rows, rounds=3, least=0.8, support=3):
    """All spans per id by plain Python: occurrences as given, their graph scored in turns, the spans chosen."""
    occurrences = {d: pii.occurrences(t, pii.base_spans(t)) for d, t in rows.items()}
    every = [o for found in occurrences.values() for o in found]
    edges = {(p, site if k == 0 else instance, instance) for _, _, _, instance, site, patterns in every for k, p in enumerate(patterns)}
    sites = collections.defaultdict(set)
    for p, site, _ in edges:
        sites[p].add(site)
    seeds = {(o[3], o[2]): 1.0 for o in every if o[2] >= 0}
    believed, trusted = dict(seeds), {}
    for _ in range(rounds):
        best = collections.defaultdict(float)
        for p, site, instance in edges:
            for kind in range(4):
                if (instance, kind) in believed:
                    best[p, site, kind] = max(best[p, site, kind], believed[instance, kind])
        masses = collections.defaultdict(list)
        for (p, _, kind), conf in best.items():
            masses[p, kind].append(conf)
        trusted = {k: min(0.99, sum(m) / len(sites[k[0]])) for k, m in masses.items() if len(m) >= support and sum(m) / len(sites[k[0]]) >= least}
        doubt = collections.defaultdict(lambda: 1.0)
        for p, site, instance in edges:
            for kind in range(4):
                if site == instance and (p, kind) in trusted:
                    doubt[instance, kind] *= 1 - trusted[p, kind]
        believed = {k: 1 - d for k, d in doubt.items() if 1 - d >= least} | seeds
    out = {}
    for d, found in occurrences.items():
        marked, readings = [], []
        for start, end, seed, instance, _, patterns in found:
            if seed < 0:
                readings.append((start, end))
                marked += [(1.0, kind, start, end) for kind in range(4) if (instance, kind) in seeds]
                for kind in range(4):
                    held = [1 - trusted[p, kind] for p in patterns if (p, kind) in trusted]
                    if held:
                        marked.append((1 - float(np.prod(held)), kind, start, end))
        out[d] = sorted(pii.base_spans(rows[d]) + pii.chosen(marked, readings))
    return out


def test_all_personal_spans_are_those_of_plain_python(spark):
    rng = np.random.default_rng(11)
    contexts = ["please call phone number {} today", "mail {} for help", "our office line is {} all week", "order {} shipped", "paid by card {} now", "the year {} was good"]
    rows = {}
    for i in range(400):
        phone, mail = f"+1 (555) {rng.integers(200, 230)}-{rng.integers(4000, 4040)}", f"user{rng.integers(60)}@mail{rng.integers(3)}.example.com"
        loose = [f"555-{rng.integers(200, 230)}-{rng.integers(4000, 4040)}", f"{mail.split('@')[0]}@intranet", str(rng.integers(1900, 2030)), "4845168114407329"]
        parts = []
        for k in rng.integers(0, 6, rng.integers(1, 3)):
            usual = [phone, mail, phone, str(rng.integers(10_000)), "4845168114407329", str(rng.integers(1900, 2030))][k]
            # some contexts are purer than others, so that patterns fall on both sides of the threshold
            odd = [0.1, 0.1, 0.3, 0.3, 0.1, 0.1][k]
            parts.append(contexts[k].format(loose[rng.integers(4)] if rng.random() < odd else usual))
        rows[i] = " and ".join(parts)
    want = plain_personal_data(rows)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: sorted((s.kind, s.start, s.end) for s in r.spans) for r in pii.find_personal_data(docs).collect()}
    assert got == want
    assert sum(map(len, want.values())) > sum(len(pii.base_spans(t)) for t in rows.values()) + 10  # some are added


@pytest.mark.parametrize("name", ENCODERS)
def test_texts_encoded_together_have_their_own_ids(name):
    plain = ENCODERS[name][1]
    texts = ["one Two three.", "", "two\nThree. one", "odd  spacing", "one <|endoftext|> two", "tab\tbed two", "\n", "two, three.\ntwo", "Ünïted two's 12 x", "three,\n"]
    cached, plain_calls = CachedEncoder(path(name), max_entries=4), []
    tokenize = cached.model_tokens
    cached.model_tokens = lambda piece: plain_calls.append(piece) or tokenize(piece)
    for most in (1, 20, 1 << 18):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in cached.encode_all(texts, most)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    # what several texts need is asked for once
    cached = CachedEncoder(path(name))
    cached.model_tokens = lambda piece: plain_calls.append(piece) or tokenize(piece)
    plain_calls.clear()
    assert len(set(cached.encode_all(["zebra one", "zebra one"]))) == 1 and len(plain_calls) == 2


def test_a_worker_keeps_its_chunks_for_the_tasks_of_a_stage(monkeypatch):
    from tidemark.llm import tokenizer

    stage = [1]
    task = type("Task", (), {"stageId": lambda self: stage[0]})
    monkeypatch.setattr(tokenizer.TaskContext, "get", lambda: task())
    found = tokenizer.encoder(path("byte_bpe_50k.json"), 10)
    list(found.encode_all(["a few words"]))
    assert tokenizer.encoder(path("byte_bpe_50k.json"), 20) is found and len(found) == 3 and found.max_entries == 20
    stage[0] = 2
    assert tokenizer.encoder(path("byte_bpe_50k.json"), 20) is found and not found
