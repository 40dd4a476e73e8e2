"""Batches of catalog mutations that see each other: each request acts on what the earlier ones have left.

A request (request_id, op, id, name, description) creates, renames, describes, archives, reactivates or deletes an entry. Requests
depend on each other only where they meet at an entry or at a name, the one they ask for or the one their entry
had before. So the batch falls into components of requests that meet; each is folded in the order of its
request_id by one task together with the entries it touches, and all components at once. What a component holds is as long as the chain of requests
that wait for each other, which no plan can shorten; entries that no request names are only joined.

The ids of created entries are given after the fold, so a request can't name an entry that its own batch creates; to it there is none.

Outcomes: created, updated, deleted; conflict, the name is another entry's; invalid, the name is blank or the operation unknown;
not_found; in_use, the entry has links.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import collapsed
from quillmesh.sources.shared import written

OPERATIONS = ("create", "rename", "describe", "archive", "reactivate", "delete")
OUTCOME = "request_id long, op string, id long, name string, key string, description string, state string, status string"
BUCKET = 1 << 16  # request ids that are numbered together


def components(pairs: DataFrame) -> DataFrame:
    """pairs (a, b: text) -> node, label: the least node that it is connected with. Each round is a table, and halves a chain."""
    both = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        further = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        moved = written(met.join(further, met["label"] == further["at"], "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("label <> old").isEmpty():
            return labels


def _fold(requests, entries):
    """The outcomes of one component's requests over its entries, both pandas tables."""
    import pandas as pd

    state = {int(e.id): {"name": e.name, "key": e.key, "description": e.description, "state": e.state} for e in entries.itertuples()}
    used = {int(e.id) for e in entries.itertuples() if e.used}
    owner = {e["key"]: i for i, e in state.items()}
    out = []
    for r in requests.sort_values(["request_id", "op"]).itertuples():
        i = None if pd.isna(r.id) else int(r.id)
        entry, status = state.get(i), None
        named, about = r.name is not None, r.description is not None
        if r.op not in OPERATIONS:
            status = "invalid"
        elif r.op == "create":
            i = None
            status = "invalid" if not r.key else "conflict" if r.key in owner else "created"
            if status == "created":
                owner[r.key] = entry = {"name": r.display, "key": r.key, "description": r.description or None, "state": "active"}
        elif entry is None:
            status = "not_found"
        elif r.op == "delete":
            status = "in_use" if i in used else "deleted"
            if status == "deleted":
                del state[i]
                owner.pop(entry["key"], None)
        else:
            if r.op == "rename" and (not named or not r.key):
                status = "invalid"
            elif r.op == "rename" and owner.get(r.key, i) != i:
                status = "conflict"
            else:
                status = "updated"
                if r.op == "rename":
                    owner.pop(entry["key"], None)
                    owner[r.key] = i
                    entry |= {"name": r.display, "key": r.key}
                if r.op in ("rename", "describe") and about:
                    entry["description"] = r.description or None
                if r.op in ("archive", "reactivate"):
                    entry["state"] = "archived" if r.op == "archive" else "active"
        shown = entry if status in ("created", "updated") else {"name": r.display, "key": r.key, "description": None, "state": None}
        out.append((int(r.request_id), r.op, i, shown["name"], shown["key"], shown["description"], shown["state"], status))
    found = pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")])
    found["id"] = found["id"].astype("Int64")
    return found


def outcomes(catalog: DataFrame, requests: DataFrame, used: DataFrame, key: Callable[[str], Column]) -> DataFrame:
    """catalog (id, name, key[, description, state]), requests (request_id, op, id, name[, description]), used (id) -> what came of each request; a created entry has its new id."""
    for column in ("description", "state"):
        if column not in catalog.columns:
            catalog = catalog.withColumn(column, F.lit("active" if column == "state" else None).cast("string"))
    if "description" not in requests.columns:
        requests = requests.withColumn("description", F.lit(None).cast("string"))
    asked = requests.select("request_id", "op", F.col("id").cast("long").alias("id"), "name", F.when(F.col("name").isNotNull(), key("name")).alias("key"), collapsed(F.col("name")).alias("display"), F.trim("description").alias("description"))
    asked = written(asked, "requests")
    at_id, at_key, at_request = (F.concat(F.lit(p), F.col(c).cast("string")) for p, c in (("i:", "id"), ("k:", "key"), ("r:", "request_id")))
    touched = catalog.join(asked.select("id").distinct(), "id", "left_semi").unionByName(catalog.join(asked.select("key").filter("key <> ''").distinct(), "key", "left_semi").select(*catalog.columns)).dropDuplicates(["id"])
    touched = written(touched.join(used.select("id").distinct().withColumn("used", F.lit(True)), "id", "left").withColumn("used", F.coalesce("used", F.lit(False))), "touched")
    asks_id = F.col("id").isNotNull() & (F.col("op") != "create")
    own = F.coalesce(F.when(asks_id, at_id), F.when(F.col("key") != "", at_key), at_request)
    links = asked.filter(asks_id & (F.col("key") != "")).select(at_id.alias("a"), at_key.alias("b"))
    links = links.unionByName(touched.select(at_id.alias("a"), at_key.alias("b"))).unionByName(asked.select(own.alias("a"), own.alias("b")))
    labels = components(links)
    rows = asked.withColumn("node", own).join(labels, "node").drop("node").withColumnRenamed("label", "component")
    entries = touched.withColumn("node", at_id).join(labels.select("node", F.col("label").alias("part")), "node").drop("node")
    folded = rows.groupBy("component").cogroup(entries.groupBy("part")).applyInPandas(_fold, OUTCOME)
    folded = written(folded, "outcomes")
    return _numbered(folded, catalog)


def _numbered(folded: DataFrame, catalog: DataFrame) -> DataFrame:
    """The new entries get the ids that follow the greatest one, in the order of their requests: numbered bucket by bucket of request ids."""
    made = folded.filter("status = 'created'").withColumn("bucket", F.floor(F.col("request_id") / BUCKET))
    top = catalog.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    before = made.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each bucket
    turn = F.row_number().over(Window.partitionBy("bucket").orderBy("request_id"))
    new = made.withColumn("turn", turn).join(before.select("bucket", "before"), "bucket").crossJoin(F.broadcast(top))  # one row
    new = new.withColumn("id", F.col("top") + F.col("before") + F.col("turn")).select(*folded.columns)
    return new.unionByName(folded.filter("status <> 'created'"))


def applied(catalog: DataFrame, found: DataFrame) -> DataFrame:
    """The catalog after the outcomes: what an entry's last update left, without the deleted, with the created."""
    names = [c for c in ("name", "key", "description", "state") if c in catalog.columns]
    last = found.filter("status IN ('updated', 'deleted')").groupBy("id").agg(F.max_by(F.struct("status", *names), "request_id").alias("last"))
    met = catalog.join(last, "id", "left").filter(F.col("last").isNull() | (F.col("last.status") != "deleted"))
    kept = met.select("id", *(F.when(F.col("last").isNull(), F.col(c)).otherwise(F.col(f"last.{c}")).alias(c) for c in names))
    return kept.unionByName(found.filter("status = 'created'").select("id", *names))
