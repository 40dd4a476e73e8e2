"""Catalog and source mutations: tables and a batch of requests in, new tables and each request's outcome out.

A batch is applied as if its requests came one after the other by ``request_id``. Requests are few against
the tables: they are joined to them by key, and only requests are numbered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import by_name


def create_named(catalog: DataFrame, requests: DataFrame, key: Column) -> DataFrame:
    """catalog (id, name, key), requests (request_id, name) -> request_id, id, name, key, status: created, conflict or invalid.

    ``key`` is the normalized name: a blank one is invalid, one that the catalog or an earlier request has is a conflict.
    """
    asked = requests.withColumn("key", key).withColumn("name", F.trim(F.regexp_replace("name", r"\s+", " ")))
    earlier = F.row_number().over(Window.partitionBy("key").orderBy("request_id"))
    held = catalog.select("key", F.lit(True).alias("held"))
    judged = asked.withColumn("turn", earlier).join(held, "key", "left")
    status = F.when(F.coalesce("key", F.lit("")) == "", "invalid").when(F.col("held") | (F.col("turn") > 1), "conflict").otherwise("created")
    top = catalog.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = judged.withColumn("status", F.coalesce(status, F.lit("created"))).crossJoin(F.broadcast(top))  # one row
    place = F.sum((F.col("status") == "created").cast("long")).over(Window.orderBy("request_id"))
    return numbered.select("request_id", F.when(F.col("status") == "created", F.col("top") + place).alias("id"), "name", "key", "status")


def rename_named(catalog: DataFrame, requests: DataFrame, key: Column) -> DataFrame:
    """requests (request_id, id, name), one for an id -> request_id, id, name, key, status: updated, conflict, invalid or not_found.

    Of several requests for one key the first that succeeds has it. Batches that mix operations are folded in ``mutation_batches``.
    """
    asked = requests.withColumn("key", key).withColumn("name", F.trim(F.regexp_replace("name", r"\s+", " ")))
    known = catalog.select("id", F.lit(True).alias("known"))
    others = catalog.select("key", F.col("id").alias("other"))
    met = asked.join(known, "id", "left").join(others, "key", "left")
    status = F.when(F.col("known").isNull(), "not_found").when(F.coalesce("key", F.lit("")) == "", "invalid").when(F.col("other").isNotNull() & (F.col("other") != F.col("id")), "conflict").otherwise("updated")
    judged = met.select("request_id", "id", "name", "key", status.alias("status"))
    turn = F.row_number().over(Window.partitionBy("key", "status").orderBy("request_id"))
    late = (F.col("status") == "updated") & (F.col("turn") > 1)
    return judged.withColumn("turn", turn).select("request_id", "id", "name", "key", F.when(late, "conflict").otherwise(F.col("status")).alias("status"))


def delete_unused(catalog: DataFrame, ids: DataFrame, links: DataFrame) -> DataFrame:
    """ids (id), links (id) -> id, status: deleted, in_use or not_found."""
    used = links.join(ids, "id", "left_semi").select("id").distinct().withColumn("used", F.lit(True))
    met = ids.join(catalog.select("id", F.lit(True).alias("known")), "id", "left").join(used, "id", "left")
    return met.select("id", F.when(F.col("known").isNull(), "not_found").when(F.col("used"), "in_use").otherwise("deleted").alias("status"))


def applied(catalog: DataFrame, created: DataFrame | None = None, updated: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """The catalog (id, name, key) after the outcomes of requests."""
    out = catalog.select("id", "name", "key")
    if deleted is not None:
        out = out.join(deleted.filter("status = 'deleted'"), "id", "left_anti")
    if updated is not None:
        new = updated.filter("status = 'updated'").select("id", F.col("name").alias("new_name"), F.col("key").alias("new_key"))
        out = out.join(new, "id", "left").select("id", F.coalesce("new_name", "name").alias("name"), F.coalesce("new_key", "key").alias("key"))
    if created is not None:
        out = out.unionByName(created.filter("status = 'created'").select("id", "name", "key"))
    return out


STATUSES = ("active", "archived")


def set_status(projects: DataFrame, requests: DataFrame) -> DataFrame:
    """projects (project_id, name, status, description) after requests (project_id, status, description), at most one for a project: archive, reactivate, describe.

    A null request field leaves its value; a status that does not exist raises; a blank description is none.
    """
    wanted = F.when(F.col("new_status").isNull() | F.col("new_status").isin(*STATUSES), F.col("new_status")).otherwise(F.raise_error(F.lit("unknown status")).cast("string"))
    new = requests.select("project_id", F.col("status").alias("new_status"), F.col("description").alias("new_description"), F.lit(True).alias("asked"))
    met = projects.join(new, "project_id", "left")
    about = F.when(F.col("new_description").isNotNull(), F.nullif(F.trim("new_description"), F.lit(""))).otherwise(F.col("description"))
    return met.select("project_id", "name", F.coalesce(wanted, "status").alias("status"), about.alias("description"))


def delete_sources(tables: dict[str, DataFrame], ids: DataFrame, confirm: bool) -> dict[str, DataFrame]:
    """Tables that have doc_id (sources, chunks, links) without some sources; a request that is not confirmed raises."""
    if not confirm:
        raise ValueError("deleting sources must be confirmed")
    return {name: df.join(ids, "doc_id", "left_anti") for name, df in tables.items()}


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with rows of equal keys replaced and the others added; the last of equal keys in rows is not defined, so they must differ."""
    return table.join(rows, key, "left_anti").unionByName(rows)


def upserted(rows: DataFrame, items: DataFrame) -> DataFrame:
    """rows (id, name) after items (request_id, id, name) that replace them by id or are added, the last of equal ids; ordered by name, then id."""
    last = items.groupBy("id").agg(F.max_by("name", "request_id").alias("name"))
    return upsert(rows.select("id", "name"), last, "id").orderBy(by_name("name"), "id")


def unselected(options: DataFrame, selected: DataFrame, ident: str) -> DataFrame:
    """The options, each once, that are not selected yet."""
    return options.distinct().join(selected.select(ident).distinct(), ident, "left_anti")


def new_links(links: DataFrame, found: DataFrame) -> DataFrame:
    """links with the pairs of found that they lack, each once."""
    return links.unionByName(found.distinct().join(links, links.columns, "left_anti"))


def duplicate_ids(requests: DataFrame, ident: str) -> DataFrame:
    """The ids that a request states more than once."""
    return requests.groupBy(ident).agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select(ident)


def missing_ids(asked: DataFrame, catalog: DataFrame, ident: str) -> DataFrame:
    """asked (pos, ident) -> those that the catalog lacks; the first is the one an error names."""
    return asked.join(catalog, ident, "left_anti").select("pos", ident)
