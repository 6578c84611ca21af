import duckdb
import pytest
import xxhash

from lakeweave.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    with duckdb.connect() as con:
        for t in ("documents", "pages"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = con.sql(oracles.oracle_sql()[name])
        got = queries.queries()[name](spark, sf_dir).select(*want.columns)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_hashes_in_sql():
    texts = ["", "a", "abcd", "abcdefg", "abcdefgh", "é" * 7, "x" * 31, "y" * 32, "z" * 33, "longer than thirty-two bytes, by far and away", "q" * 100, "ñ|" * 41]
    with duckdb.connect() as con:
        con.sql("CREATE TABLE given (rid INT, s VARCHAR)")
        con.executemany("INSERT INTO given VALUES (?, ?)", list(enumerate(texts)))
        got = dict(con.sql(f"WITH {oracles._xxh64('given')} SELECT rid, h FROM hashes").fetchall())
    assert got == {i: xxhash.xxh64_intdigest(t.encode(), 42) for i, t in enumerate(texts)}
