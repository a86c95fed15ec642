"""Every registered query next to its SQL on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from shelfmark.plans.queries import ORACLE, QUERIES
from tests.compare import connection, differences

FOLDER = os.environ.get("QUERY_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    _, diff = differences(spark, con, name, QUERIES[name], ORACLE.get(name), FOLDER)
    assert not diff


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", ["adapter_zlib3", "file_import_order", "file_import"])
def test_empty_text(spark, folder, name):
    """Next to its SQL where one document has no text."""
    for table in ("documents", "labels"):
        rows = spark.read.parquet(f"{FOLDER}/{table}.parquet")
        if table == "documents":
            empty = rows.filter("lang <> 'es'").agg(F.max("doc_id")).first()[0]
            rows = rows.withColumns({
                "text": F.when(F.col("doc_id") == empty, "").otherwise(F.col("text")),
                "n_chars": F.when(F.col("doc_id") == empty, 0).otherwise(F.col("n_chars")),
            })
        rows.toPandas().to_parquet(f"{folder}/{table}.parquet")
    _, diff = differences(spark, connection(folder), name, QUERIES[name], ORACLE[name], folder)
    assert not diff
