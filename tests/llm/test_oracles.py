"""The corpus queries that SQL can express, against DuckDB."""

import os

import pytest

from graphlens.llm import registry

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracle_sql())


def flat(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def compare(df, sql, files):
    import duckdb

    con = duckdb.connect()
    for name, path in files.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    columns = sorted(df.columns)
    got = sorted(tuple(map(flat, r)) for r in df.select(*columns).collect())
    answer = con.execute(sql)
    have = [c[0] for c in answer.description]
    assert sorted(have) == columns
    assert got == sorted(tuple(flat(r[have.index(c)]) for c in columns) for r in answer.fetchall())
    return got


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    files = {f.split(".")[0]: f"{SF}/{f}" for f in os.listdir(SF)}
    assert compare(registry.queries()[name](spark, SF), registry.oracle_sql()[name], files)


@pytest.mark.parametrize("name", ["op3_near_duplicates", "op7_repeated_substrings"])
def test_oracle_on_chains_and_overlaps(spark, tmp_path, name):
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[k : k + 56]), "a") for k in range(4)]  # each near the next, the first not near the last
    rows += [(10, "A b c", "a"), (11, "a  B\tc", "b"), (12, "", "a"), (13, None, "a"), (14, "é" * 120, "a"), (15, "é" * 70 + "x" * 99 + "é" * 70, "b"), (16, "ab" * 150, "b")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(path)
    assert len(compare(registry.queries()[name](spark, str(tmp_path)), registry.oracle_sql()[name], {"documents": path + "/*.parquet"})) == len(rows)
