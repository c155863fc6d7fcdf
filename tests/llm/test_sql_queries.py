"""Queries with DuckDB SQL, on the smallest tables and on edge rows."""

import os

import duckdb
import pytest

from cadenza.llm.oracles import ORACLES
from cadenza.llm.queries import QUERIES

from .conftest import EDGE_TEXTS


#: Queries over documents; those of other tables have edge rows of their own.
OF_DOCUMENTS = sorted(name for name, sql in ORACLES.items() if "FROM documents" in sql)


def run_sql(sf_dir, sql):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    return sorted((tuple(str(r[rel.columns.index(n)]) for n in names) for r in rel.fetchall())), names


def run_spark(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    return sorted(tuple("None" if v is None else str(v) for v in r) for r in df.select(*names).collect()), names


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_small_tables(spark, sf_small, name):
    assert run_spark(spark, sf_small, name) == run_sql(sf_small, ORACLES[name])


LINES = ["Home | News | About | Contact", "One plain sentence that stays here.", "A B C!!! D!!! E!!!",
         "All rights reserved 2020.", "no end", "x### y$$$ z%%% a&&&.", "  indented line of words, kept.  ", "Login"]


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_edge_rows(spark, tmp_path, name):
    texts = [*EDGE_TEXTS[:-2], "\n".join(LINES), "\n".join(LINES[1:2] * 30 + LINES[6:7]), "a b c d e " * 40, "x\v\f\ry"]
    rows = [(None if i % 7 == 6 else i // 2, t, ("en", "fr", None, "xx")[i % 4], ("src1", "src12", None, "odd")[i % 3])
            for i, t in enumerate(texts * 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    assert run_spark(spark, str(tmp_path), name) == run_sql(str(tmp_path), ORACLES[name])


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    assert run_spark(spark, str(tmp_path), name)[0] == []
