"""Snapshots and restores: a dropped, a changed and a doubled row are found."""

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import snapshots


def test_restore_checks(spark, tmp_path):
    rows = spark.createDataFrame([(k, None if k % 5 == 0 else f"t{k}", [float(k)], {"a": str(k)}) for k in range(40)], "id long, name string, v array<double>, m map<string,string>")
    tables = {"rows": rows, "few": rows.select("id", "name").limit(3), "none": rows.filter("id < 0"), "lost": rows.select("id")}
    manifest = snapshots.snapshot(spark, tables, str(tmp_path / "s"))
    back = snapshots.restored(spark, str(tmp_path / "s"))
    assert {r.status for r in snapshots.checks(manifest, {k: v.repartition(7) for k, v in back.items()}).collect()} == {"ok"}
    changed = rows.withColumn("name", F.when(F.col("id") == 7, "other").otherwise(F.col("name")))
    moved = rows.withColumn("name", F.when(F.col("id") == 5, "t6").when(F.col("id") == 6, None).otherwise(F.col("name")))
    for broken, want in ((rows.filter("id <> 9"), "rows_differ"), (changed, "content_differs"), (moved, "content_differs"), (rows.filter("id <> 9").union(rows.filter("id = 8")), "content_differs"), (rows.drop("name"), "columns_differ")):
        got = {r.table: r.status for r in snapshots.checks(manifest, {"rows": broken, "few": back["few"], "none": back["none"], "new": rows}).collect()}
        assert got == {"rows": want, "few": "ok", "none": "ok", "lost": "missing", "new": "unexpected"}
    with pytest.raises(Exception):
        snapshots.restored(spark, str(tmp_path / "nothing"))
