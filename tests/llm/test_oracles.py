"""Corpus queries with an oracle against it, on the smallest tables; XXH64 in SQL against the library."""

import glob
import os
from collections import Counter

import pytest
import xxhash

from tessella.llm import queries, simhash_sql

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_xxh64_in_sql():
    texts = ["", "a", "abcd", "é" * 20, *("xyz"[n % 3] * n for n in range(1, 140, 3))]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(t,) for t in texts])
    got = dict(con.sql(f"WITH {simhash_sql.xxh64('t', 42)} SELECT s, h FROM hashed").fetchall())
    assert got == {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in texts}
