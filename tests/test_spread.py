"""Tables of few bytes whose rows become much work are not left to the one task that scans them."""

import pytest
from pyspark.sql import functions as F

from loomwork.operators import heic_rows
from loomwork.plans import container_queries, part_queries
from loomwork.shared import settings
from loomwork.sources import files, headers

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("made", [part_queries.previewed, part_queries.preview_files, container_queries.tile_places])
def test_files_of_a_small_table(spark, made):
    rows = made(spark, DIR).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(rows) >= 4 and max(r["count"] for r in rows) < sum(r["count"] for r in rows) / 2


def test_tables_of_files_are_not_broadcast(spark):
    files = part_queries.heic_files(spark, DIR).withColumnRenamed("page_id", "f")
    plan = heic_rows.cuts(heic_rows.Tables(files))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_tables_of_files_are_read_and_joined_once(spark):
    t = heic_rows.Tables(part_queries.heic_files(spark, DIR).withColumnRenamed("page_id", "f"))
    tables = (t.boxes, t.items, t.extents, t.references, t.associations)
    assert len({path.split("/tbl=")[0] for table in tables for path in table.inputFiles()}) == 1
    for df in (t.gone, t.places):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_many_small_files_share_tasks(spark, tmp_path):
    for k in range(600):
        (tmp_path / f"{k}.bin").write_bytes(b"x" * k)
    with settings(spark, files.MANY):
        scanned = files.scan(spark, f"file://{tmp_path}")
        assert scanned.rdd.getNumPartitions() <= 16 and scanned.agg(F.sum("length"), F.count("content")).first() == (599 * 300, 599)
    assert len(headers.HeaderReader({"path": f"file://{tmp_path}"}).partitions()) == 1
