"""Every query with SQL against DuckDB on the smallest tables, and all on odd rows."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quernstone.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def key(row):
    return tuple("" if v is None else repr(0.0 if v == 0 and isinstance(v, float) else v) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    wanted = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(map(key, got)) == sorted(map(key, wanted))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


ODD = [None, "", " ", ".", "\n\n\n", "!!!!!!", "one", "É", "\U0001f600", "a.\n\nb", "Chapter 1\n\nChapter 3", "the same text", "the same text", "<p>&amp;", "A sentence here. Another sentence follows it. " * 50]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    for name in TABLES:
        spark.read.parquet(f"{SF}/{name}.parquet").limit(3).write.parquet(f"{folder}/{name}.parquet", mode="overwrite")
    rows = [(k, t, "en", "src", 1) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b").alias("url"), F.col("text").alias("html")).write.mode("overwrite").parquet(f"{folder}/pages.parquet")
    docs.select((F.col("doc_id") % 4).alias("conv_id"), F.col("doc_id").alias("turn"), F.when(F.col("doc_id") % 2 == 0, "user").otherwise("assistant").alias("role"), "text").write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, name):
    """Null, empty and strange texts give rows, not errors."""
    QUERIES[name](spark, odd).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(SF)
