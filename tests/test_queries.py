"""Every query with SQL gives the same rows in both engines."""

import duckdb
import pytest

from vellum.plans import stage_queries, table_queries, text_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {**text_queries.Q, **table_queries.Q, **stage_queries.Q}
SQL = {**text_queries.SQL, **table_queries.SQL, **stage_queries.SQL}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    assert got or name in ("page_numbers", "number_lost")
    if name in SQL:
        q = con.execute(SQL[name])
        names = [d[0] for d in q.description]
        assert sorted(names) == columns
        assert got == sorted(([plain(dict(zip(names, r, strict=True))[c]) for c in columns] for r in q.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and {"integrity_findings"} <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "rule_no", "kind"]


def test_nothing_else_needs_the_subpackage():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for p in (root / "vellum").rglob("*.py"):
        if "llm" not in p.parts:
            names = [n.module or "" for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not any("llm" in n for n in names), p
