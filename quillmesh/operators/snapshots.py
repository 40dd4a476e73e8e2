"""Snapshots of tables and the checks of their restore.

A snapshot is a folder of Parquet tables and a manifest with a digest of each: the number of rows, and the sum and the exclusive or of the rows' 64-bit
hashes, which do not depend on their order or on how they are dealt out. A restore is right where the digests are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "table string, n long, added decimal(38,0), mixed long, columns string"


def digest(df: DataFrame) -> DataFrame:
    """One row: n, added, mixed, columns. A row's hash is over its columns by name, nulls and their places included; maps by their entries in order."""
    parts = []
    for name, kind in sorted(df.dtypes):
        value = F.array_sort(F.map_entries(F.col(f"`{name}`"))) if kind.startswith("map<") else F.col(f"`{name}`")
        parts += [F.lit(name), value.isNull(), value]
    row = F.xxhash64(*parts)
    columns = ",".join(f"{n}:{k}" for n, k in sorted(df.dtypes))
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("added"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("mixed")).withColumn("columns", F.lit(columns))


def digests(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n, added, mixed, columns of each table."""
    out = None
    for name, df in tables.items():
        one = digest(df).select(F.lit(name).alias("table"), "n", "added", "mixed", "columns")
        out = one if out is None else out.unionByName(one)
    return out


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes the tables and, when all are whole, their manifest; returns it. The digests are of what was written."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    digests({name: spark.read.parquet(f"{folder}/{name}") for name in tables}).coalesce(1).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def restored(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a snapshot by name; one without its manifest is not whole and raises."""
    names = [r.table for r in spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").select("table").collect()]
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def checks(manifest: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """table, expected, found (rows), status: ok, missing, unexpected, columns_differ, rows_differ (in number) or content_differs."""
    now = digests(tables).select("table", F.col("n").alias("found"), F.col("added").alias("added_"), F.col("mixed").alias("mixed_"), F.col("columns").alias("columns_"))
    met = manifest.withColumnRenamed("n", "expected").join(now, "table", "full_outer")
    status = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("expected").isNull(), "unexpected")
        .when(F.col("columns") != F.col("columns_"), "columns_differ")
        .when(F.col("expected") != F.col("found"), "rows_differ")
        .when((F.col("added") != F.col("added_")) | (F.col("mixed") != F.col("mixed_")), "content_differs")
        .otherwise("ok")
    )
    return met.select("table", "expected", "found", status.alias("status"))


def by_status(checked: DataFrame) -> DataFrame:
    """status, n_tables, n_rows of a restore's checks: it is right where all are ok."""
    return checked.groupBy("status").agg(F.count(F.lit(1)).alias("n_tables"), F.sum(F.coalesce("found", F.lit(0))).alias("n_rows"))
