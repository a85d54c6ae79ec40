"""Queries whose rows hang on texts that are there but blank, against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

BLANK = {0: "", 5: " ", 13: " \n\t", 24: "　", 33: "", 34: " ", 45: " ", 47: " "}


@pytest.mark.parametrize("name", ["batch_pipeline", "budget_api"])
def test_blank_texts(name, spark, tmp_path):
    rows = [(i, BLANK.get(i, f"Text {i}. It has two sentences. "), "en", f"src{i % 3}") for i in range(60)]
    folder = tmp_path / "documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(folder))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
