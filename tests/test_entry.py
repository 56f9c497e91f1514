import sys

import duckdb
import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, ROOT)
import __spark_entry__ as E  # noqa: E402


TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def test_entry_flagship(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 3 and {r["model"] for r in rows} == {"A", "N", "R"}


def test_every_query_has_a_callable_and_sql_keys_match():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 40


MAY_BE_EMPTY = {"failed_requests", "invalid_report", "op10_edit_decontam"}


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_runs_on_smallest_scale(spark, name):
    """Every query gives rows with distinct column names, and as many rows as its oracle."""
    df = E.queries()[name](spark, SF_SMALL)
    n = df.count()
    assert len(df.columns) == len(set(df.columns))
    assert n > 0 or name in MAY_BE_EMPTY
    if name in E.oracle_sql():
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
        sql = E.oracle_sql()[name]
        assert sorted(c[0] for c in con.execute(f"DESCRIBE ({sql})").fetchall()) == sorted(df.columns)
        assert con.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] == n


def test_alphabet_check_of_whole_texts(spark, tmp_path):
    texts = ["CC(=O)[NH3+]", "CC(=O)S", "C)C(", "[13CH4] and " + "N" * 5000, "", None]
    spark.createDataFrame(list(enumerate(texts)), "conv_id int, text string").selectExpr("conv_id", "0 AS turn", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in E.queries()["token_alphabet_texts"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert got == sorted(con.execute(E.oracle_sql()["token_alphabet_texts"]).fetchall())
    assert [r[2] for r in got] == [True, False, False, False, False, False]
    assert got[0][3] == 4 and got[3][3] > 5000 and got[4][3] == 0 and got[5][3] is None
