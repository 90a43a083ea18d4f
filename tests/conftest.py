from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    work = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.local.dir": work,
        "spark.checkpoint.dir": f"{work}/ck", "spark.sql.warehouse.dir": f"{work}/wh", "spark.ui.showConsoleProgress": "false",
    }
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data() -> str:
    return DATA


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(columns, records) -> list:
    """Rows as sorted text, columns by name, doubles to nine digits, so two engines' results compare."""

    def show(x):
        if x is None or isinstance(x, float) and x != x:
            return "null"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
            return f"{float(x):.9g}"
        if isinstance(x, (list, tuple)):
            return "[" + ",".join(map(show, x)) + "]"
        return str(x)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(show(r[i]) for i in order) for r in records)


@pytest.fixture(scope="session")
def same(spark, duck, data):
    """Hold a query against its SQL; the number of rows comes back."""

    def check(query, sql) -> int:
        got, want = query(spark, data), duck.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(names)
        a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(names, want.fetchall())
        assert a == b
        return len(a)

    return check
