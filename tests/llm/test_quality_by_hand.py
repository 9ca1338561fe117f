"""Every verdict of the quality rules against numpy: estimates of all levels, their shrinking, distances."""

import duckdb
import numpy as np

from tidemark.llm import quality_rules as Q
from tidemark.llm import queries

from test_parts import mcd_by_hand


def features(row, n_lines):
    share = lambda a, b, more: np.arcsin(np.sqrt(min(1.0, a / (b + more))))
    return [
        np.log1p(row.n_words), np.log1p(row.word_chars / max(row.n_words, 1)), share(row.n_symbols, row.word_chars, 50), share(row.n_dup_lines, n_lines, 5), share(row.n_repeat_words, row.n_words, 50)
    ]


def shrunk(own, parent, prior):
    """(n, centre, covariance) with weight n / (n + prior), the rest from the parent."""
    w = own[0] / (own[0] + prior)
    return own[0], parent[1] + w * (own[1] - parent[1]), parent[2] + w * (own[2] - parent[2])


def test_distances_and_verdicts_of_all_documents(spark, sf_dir):
    docs = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{sf_dir}/documents.parquet'").df().set_index("doc_id")
    got = queries.op1_quality_rules(spark, sf_dir).toPandas().set_index("doc_id")
    n_lines = {d: sum(any(c not in " \t\n\x0b\x0c\r" for c in line) for line in (t or "").split("\n")) for d, t in docs.text.items()}
    passing = [d for d in got.index if not got.base_failed[d]]
    x = {d: np.array(features(got.loc[d], n_lines[d])) for d in passing}
    floor = np.diag(np.array(list(Q.FEATURES.values())) ** 2)
    groups = {}
    for d in passing:
        for key in (("a",), ("l", docs.lang[d]), ("s", docs.lang[d], docs.source[d])):
            groups.setdefault(key, []).append(x[d])
    found = {k: (len(v), *mcd_by_hand(np.array(v), floor, 0.75, 3)) for k, v in groups.items()}
    compared = 0
    for d in passing:
        lang, source = docs.lang[d], docs.source[d]
        _, centre, covariance = shrunk(found["s", lang, source], shrunk(found["l", lang], found["a",], 50.0), 50.0)
        gap = x[d] - centre
        distance = gap @ np.linalg.solve(covariance + floor, gap)
        assert np.isclose(got.distance2[d], distance, rtol=1e-6), d
        assert got.kept[d] == (distance <= Q.CHI2_REJECT)
        compared += 1
    assert compared > 100 and 0 < sum(got.kept[d] for d in passing) < compared
    assert not got.kept[got.base_failed].any() and got.distance2[got.base_failed].isna().all()
