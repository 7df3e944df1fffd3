"""Queries on nodes against their SQL where two files share an id: parts whose numbers differ by a million."""

import duckdb
import pytest
from pyspark.sql import functions as F

from grove.operators import nodes
from grove.plans.catalog import ORACLES, QUERIES

NODE = "path string, kind string, file_id long, hash string, size int, mode int"


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared-ids"))
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 1_000_000)).write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("name", ["diff2_legacy", "diff2_node_moves", "diff2_rows", "diff3_nodes"])
def test_against_sql(spark, shared, name):
    found = QUERIES[name](spark, shared)
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{shared}/part.parquet/*.parquet')")
    answer = engine.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLES[name]})")
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, answer.fetchall()))


def test_every_add_meets_every_delete(spark):
    row = lambda path, i: (path, "file", i, "h", 1, 420)
    before, after = [row("a", 1), row("b", 1), row("z", 0), row("n", 2)], [row("c", 1), row("d", 1), row("y", 0), row("m", 3)]
    rows = nodes.collected(spark.createDataFrame(before, NODE), spark.createDataFrame(after, NODE), each=True).collect()
    assert sorted((r.action, r.path, r.from_path or "") for r in rows) == [
        ("add", "m", ""), ("add", "y", ""), ("delete", "n", ""), ("delete", "z", ""), ("move", "c", "a"), ("move", "c", "b"), ("move", "d", "a"), ("move", "d", "b"),
    ]
