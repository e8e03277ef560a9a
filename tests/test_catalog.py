"""Every catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from codeloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: int(v) if isinstance(v, float) and v == int(v) else v
    return sorted(str([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, con, name):
    got = catalog.queries()[name](spark, SF)
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_names(spark):
    from pyspark.sql import functions as F

    from codeloom.functions import names

    df = spark.createDataFrame([("getFileName_x", "int (char *, int[3][4])", "[12:7]", "0x1F")], "n string, s string, p string, a string")
    r = df.select(names.camel_tokens(F.col("n")).alias("a"), names.parameter_types(F.col("s")).alias("b"), names.return_type(F.col("s")).alias("c"), names.position(F.col("p")).alias("d"), names.address(F.col("a")).alias("e"), names.type_class(F.lit("int[3][4]")).alias("f")).first()
    assert r.a == ["get", "File", "Name", "x"] and r.b == ["char *", "int[3][4]"] and r.c == "int" and tuple(r.d) == (12, 7) and r.e == 31 and r.f == "multi_array"


def test_without_sql(spark):
    """What SQL cannot express runs and gives rows; the operators behind have tests against plain-Python models."""
    for name in catalog.queries().keys() - catalog.oracle_sql().keys():
        got = catalog.queries()[name](spark, SF)
        assert got.count() > 0
