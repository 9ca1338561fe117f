"""Operators 2 and 3: every row of their queries against plain Python."""

import collections
import math
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import language_id, quality_classifier, queries


@pytest.fixture(scope="module")
def docs(sf_dir):
    return duckdb.sql(f"SELECT * FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").df()


def strength(sites, least=2.0, most=1000.0):
    """From (good, n, parent share) of the sites of a level."""
    sites = [s for s in sites if s[1] >= 2]
    spread = sum(n * (g / n - p) ** 2 for g, n, p in sites)
    expected = sum(p * (1 - p) for _, _, p in sites)
    between = sum((n - 1) * p * (1 - p) for _, n, p in sites)
    return most if spread <= expected or not between else min(most, max(least, between / (spread - expected) - 1))


def test_op2_scores_are_those_of_plain_python(spark, sf_dir, docs):
    labels = duckdb.sql(f"SELECT doc_id, min(CAST(quality = 1 AND toxic = 0 AS INT)) AS good FROM '{sf_dir}/labels.parquet' GROUP BY doc_id").df()
    good = dict(zip(labels.doc_id, labels.good))
    text = dict(zip(docs.doc_id, docs.text))
    fitted = sorted(d for d in good if d in text)
    n_good = sum(good[d] for d in fitted)
    n_bad = len(fitted) - n_good
    held = {d: quality_classifier.features(t) for d, t in text.items()}
    counts = {k: collections.Counter(f for d in fitted if good[d] == k for f in held[d]) for k in (0, 1)}

    def z(f):
        g, b = counts[1][f], counts[0][f]
        odds = math.log((g + 0.5) / (n_good - g + 0.5)) - math.log((b + 0.5) / (n_bad - b + 0.5))
        return abs(odds) / math.sqrt(1 / (g + 0.5) + 1 / (b + 0.5))

    names = {f for f in counts[0] | counts[1] if counts[0][f] + counts[1][f] >= 3 and z(f) >= 3.0}
    assert 0 < len(names) <= 4000
    place = {f: i for i, f in enumerate(sorted(names))}
    rows = [sorted(place[f] for f in held[d] & names) for d in fitted]
    bias, w = quality_classifier.fit_logistic(rows, np.array([good[d] for d in fitted], float), len(names))
    prior = math.log(n_good / n_bad)
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    evidence, p = {}, {}
    for d, found in held.items():
        mine = [w[place[f]] for f in found & names]
        evidence[d] = max(-12.0, min(12.0, bias + sum(mine) / math.sqrt(max(1, len(mine))) - prior))
        p[d] = sigmoid(evidence[d] + prior)

    host, path = dict(zip(docs.doc_id, docs.source)), dict(zip(docs.doc_id, zip(docs.source, docs.lang)))
    at = lambda of: {k: (sum(p[d] for d in of if of[d] == k), sum(x == k for x in of.values())) for k in set(of.values())}
    hosts, paths = at(host), at(path)
    share = (sum(p.values()) + 1) / (len(p) + 2)
    k_host = strength([(g, n, share) for g, n in hosts.values()])
    mean = {h: (k_host * share + g) / (k_host + n) for h, (g, n) in hosts.items()}
    k_path = strength([(g, n, mean[h]) for (h, _), (g, n) in paths.items()])

    got = queries.QUERIES["op2_quality_classifier"](spark, sf_dir).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(text)
    for d, row in got.iterrows():
        (hg, hn), (pg, pn) = hosts[host[d]], paths[path[d]]
        host_score = (k_host * share + hg - p[d]) / (k_host + hn - 1)
        path_score = (k_path * host_score + pg - p[d]) / (k_path + pn - 1)
        site = min(1 - 1e-6, max(1e-6, path_score))
        score = sigmoid(evidence[d] + math.log(site / (1 - site)))
        assert np.allclose([row.doc_score, row.host_score, row.path_score, row.score], [p[d], host_score, path_score, score], rtol=1e-6, atol=1e-9)
        assert abs(score - 0.5) < 1e-6 or row.kept == (score >= 0.5)


def test_logistic_fit_is_near_its_optimum():
    rng = np.random.default_rng(5)
    rows = [sorted(set(rng.integers(0, 12, 5).tolist())) for _ in range(300)]
    good = np.array([float((0 in r) + 0.3 * rng.normal() > 0.4) for r in rows])
    bias, w = quality_classifier.fit_logistic(rows, good, 12)
    x = np.zeros((300, 13))
    for i, r in enumerate(rows):
        x[i, r] = 1 / math.sqrt(len(r))
    x[:, 12] = 1
    ridge = np.r_[np.full(12, 1e-3 / math.sqrt(300)), 0.0]

    def loss(v):
        s = x @ v
        return float(np.mean(np.logaddexp(0, s) - good * s) + 0.5 * (ridge * v * v).sum())

    best = np.zeros(13)
    for _ in range(60):  # Newton's method
        q = 1 / (1 + np.exp(-(x @ best)))
        best -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x / 300 + np.diag(ridge) + 1e-12 * np.eye(13), x.T @ (q - good) / 300 + ridge * best)
    assert loss(best) <= loss(np.r_[w, bias]) <= loss(best) + 0.01


def trigrams(word, buckets):
    """Buckets of the trigrams around every letter of a word, its letters, and their scripts."""
    letters = [ord(c) if c.isalpha() else 0 for c in word.lower()]
    padded, out = [0, *letters, 0], []
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        if b:
            h = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
            h ^= h >> 15
            out.append((h * 0x27D4EB2F & 0xFFFFFFFF) >> (32 - buckets.bit_length() + 1))
    return out, {language_id.script_of(chr(x)) for x in letters if x}


def test_op3_predictions_are_those_of_plain_python(spark, sf_dir, docs):
    buckets, penalty = 1 << 16, 8.0
    out = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in docs.doc_id}
    grams, scripts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for d, text, lang in zip(docs.doc_id, docs.text, docs.lang):
        if not out[d] and lang is not None:
            for word in text.split():
                found, used = trigrams(word, buckets)
                grams[lang].update(found)
                scripts[lang].update({s: len(found) for s in used})
    languages = sorted(grams)
    total = {k: sum(grams[k].values()) + 0.5 * buckets for k in languages}
    allowed = {k: {s for s, n in scripts[k].items() if n >= 0.01 * sum(scripts[k].values())} for k in languages}
    known = {}

    def score(word):
        if word not in known:
            found, used = trigrams(word, buckets)
            fits = [k for k in languages if used & allowed[k]]
            row = [sum(math.log((grams[k][f] + 0.5) / total[k]) for f in found) if k in fits else -1e4 if fits else 0.0 for k in languages]
            known[word] = [x - max(row) for x in row], len(found)
        return known[word]

    got = queries.QUERIES["op3_language_id"](spark, sf_dir).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(docs.doc_id)
    n = len(languages)
    for d, text in zip(docs.doc_id, docs.text):
        words = text.split()
        best, back = [0.0] * n, []
        for i, word in enumerate(words):
            if i:
                top = best.index(max(best))
                stay = [best[k] >= best[top] - penalty for k in range(n)]
                back.append([k if stay[k] else top for k in range(n)])
                best = [best[k] if stay[k] else best[top] - penalty for k in range(n)]
            best = [b + e for b, e in zip(best, score(word)[0])]
        label = best.index(max(best))
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        labels.reverse()
        letters = [sum(score(w)[1] for w, k in zip(words, labels) if k == lang) for lang in range(n)]
        row = got.loc[d]
        assert row.held_out == out[d]
        if not sum(letters):
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        pick = letters.index(max(letters))
        sums = [sum(score(w)[0][k] for w in words) for k in range(n)]
        posterior = 1 / sum(math.exp(x - sums[pick]) for x in sums) if max(sums) - sums[pick] < 700 else 0.0
        assert row.lang_pred == languages[pick]
        assert math.isclose(row.score, letters[pick] / sum(letters) * posterior, rel_tol=1e-3, abs_tol=1e-6)
        assert row.n_spans == 1 + sum(a != b for a, b in zip(labels, labels[1:]))
