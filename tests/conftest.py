import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("OMP_NUM_THREADS", "1")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def same_rows(df, rows: "object") -> None:
    """df against a DuckDB result: columns, types of numbers, and rows in any order."""
    import math

    def norm(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        if isinstance(v, (list, tuple)):
            return tuple(map(norm, v))
        return v if v is None or isinstance(v, (int, str, bool)) else str(v)

    cols = sorted(df.columns)
    assert sorted(rows.column_names) == cols
    a, b = df.select(*cols).toArrow(), rows.select(cols)
    assert [str(f.type) for f in a.schema] == [str(f.type) for f in b.schema]
    left, right = (sorted((tuple(map(norm, r.values())) for r in t.to_pylist()), key=repr) for t in (a, b))
    assert left == right
