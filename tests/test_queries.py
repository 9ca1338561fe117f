"""Every registered query of the corpus operators against its SQL, and the shape of the contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(str([plain(v) for v in r]) for r in frame.where(frame.notna(), None).values.tolist())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLE_SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = con.execute(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        import re

        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
        regex = re.compile("|".join(f"(?:{p.regex})" for p in catalog.PATTERNS))
        lines = [(d, i, x) for d, t in zip(docs.doc_id, docs.text) for i, x in enumerate(t.split("\n"), 1)]
        assert sorted(map(tuple, got.values.tolist())) == sorted((d, i, *m.span()) for d, i, x in lines for m in regex.finditer(x))


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
