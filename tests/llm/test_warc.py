import hashlib
import random

import duckdb
import pytest

from vellum.llm import warc as W
from vellum.llm.common import scratch

KIND = "page_id long, url string, html string"


def written(spark, rows, parts=1, block=1 << 27):
    """Writes rows and reads them back with blocks of so many bytes."""
    path = scratch(spark, "warc-test")
    W.write(spark.createDataFrame(rows, KIND).repartition(parts), path)
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        return W.read(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def hostile(n=80):
    rng = random.Random(5)
    fake = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: {}\r\n\r\n"
    bits = ["a", "\r\n", "\r\n\r\n", "WARC/1.1\r\n", "\nWARC/1.1\r\n", "é", "\r", "\n", *(fake.format(k) for k in (0, 3, 57, 400))]
    rows = []
    for i in range(n):
        t = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 5, 9])))
        rows.append((i, rng.choice(["http://a/", "b\r\nX: y", None]), None if i % 7 == 0 else "x" * 1200 if i % 11 == 0 else t))
    return rows


@pytest.mark.parametrize(("parts", "block"), [(1, 1 << 27), (3, 1 << 27), (1, 2500)])
def test_magic_inside_payloads_is_rejected(spark, parts, block):
    rows = hostile()
    got = {r.page_id: r for r in written(spark, rows, parts, block)}
    assert len(got) == len(rows)
    for i, _, t in rows:
        if got[i].kind == "response":
            b = (t or "").encode()
            assert (got[i].payload_bytes, got[i].digest) == (len(b), hashlib.sha1(b).hexdigest())
    assert {r.refers_to for r in got.values() if r.kind == "revisit"} == {66}


def test_damage_is_found(spark, tmp_path):
    path = tmp_path / "a.warc"
    path.write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n")
    with pytest.raises(ValueError, match="chain"):
        W.read(spark, str(path)).collect()


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    assert sorted(map(str, (tuple(r) for r in W.op6_warc(spark, sf).collect()))) == sorted(map(str, con.execute(W.ORACLE_SQL).fetchall()))


def test_awkward_pages(spark):
    rows = [(1, "u", "y" * 1500), (5, "u", "y" * 1500), (5, "u", "y" * 1500), (None, None, "y" * 1500), (None, None, None), (2, "", ""), (3, "u", "y" * 999), (4, "u", "y" * 999)]
    got = sorted(written(spark, rows), key=str)
    assert len(got) == 8
    assert sorted(((r.page_id or -1), r.kind, r.refers_to) for r in got if (r.payload_bytes or 0) >= 1000 or r.kind == "revisit") == [(-1, "revisit", 5), (1, "revisit", 5), (5, "response", None), (5, "response", None)]
    assert all(r.kind == "response" for r in got if r.page_id in (2, 3, 4))


def test_empty_table(spark):
    assert written(spark, []) == []


def test_one_page_id_with_two_payloads(spark, tmp_path):
    y, z = "y" * 1500, "z" * 1700
    spark.createDataFrame([(1, "u", y), (5, "u", y), (5, "u", z)], KIND).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.op6_warc(spark, str(tmp_path)).collect())
    dy, dz = (hashlib.sha1(t.encode()).hexdigest() for t in (y, z))
    assert sorted(got, key=str) == sorted([(1, 1500, dy, "revisit", 5), (5, 1500, dy, "response", None), (5, 1700, dz, "response", None)], key=str)
