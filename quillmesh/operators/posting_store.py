"""Postings that stay current: changes of sources are appended to a partitioned table, reads leave out what later changes replace, merges rewrite small parts.

A part holds the postings of some changed sources (``postings``) and the ids of all sources that they replace or delete
(``replaced``). A posting counts where no later part names its source. Each change writes its part first and then one row that
names all parts now in use, so a change that is cut off leaves the table as it was, and may be run again. One writer at a time
is assumed, as with any table that a single job maintains; readers need no lock.

Each task writes its postings by term to a file of its own, so a change shuffles nothing and a common term lies in many files. A merge takes the latest parts while the one before
them has at most `FANOUT` times their rows, and is done where these are `FANOUT` at least: every row is rewritten about once for each
power of `FANOUT` that the table grows by, and a search reads few parts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import retrieval
from quillmesh.sources.shared import exists, removed

FANOUT = 4
PARTS = "parts array<struct<name:long,place:long,n_rows:long>>"
POSTINGS = "term string, chunk_id long, doc_id long, positions array<int>"


class Cut(Exception):
    """A change that ends before it is in use, as tests want it."""


@dataclass(frozen=True)
class Part:
    name: int  # of its folders, never used twice
    place: int  # in the order of changes; a merged part has the last of its places
    n_rows: int


@dataclass(frozen=True)
class PostingStore:
    spark: SparkSession
    folder: str

    def state(self) -> tuple[int, list[Part]]:
        """The number of the last change, and the parts in use in the order of changes."""
        if not exists(self.spark, f"{self.folder}/states"):
            return 0, []
        states = self.spark.read.schema(f"{PARTS}, state long").parquet(f"{self.folder}/states")
        last = states.orderBy(F.desc("state")).first()
        return last["state"], [Part(*p) for p in last["parts"]]

    def _use(self, state: int, parts: list[Part]) -> None:
        rows = self.spark.createDataFrame([([(p.name, p.place, p.n_rows) for p in parts],)], PARTS)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/states/state={state}")

    def _read(self, parts: list[Part], table: str, schema: str) -> DataFrame:
        """The rows of some parts with their place."""
        if not parts:
            return self.spark.createDataFrame([], f"{schema}, place long")
        each = [self.spark.read.schema(schema).parquet(f"{self.folder}/{table}/{p.name}").withColumn("place", F.lit(p.place).cast("long")) for p in parts]
        return reduce(DataFrame.unionByName, each)

    def _current(self, parts: list[Part], terms: list[str] | None = None) -> DataFrame:
        rows = self._read(parts, "postings", POSTINGS)
        if terms is not None:
            rows = rows.filter(F.col("term").isin(terms))
        if len(parts) < 2:  # nothing is later
            return rows.select("term", "chunk_id", "doc_id", "positions")
        last = self._read(parts[1:], "replaced", "doc_id long").groupBy("doc_id").agg(F.max("place").alias("last"))
        met = rows.join(last, rows["doc_id"].eqNullSafe(last["doc_id"]), "left").drop(last["doc_id"])
        return met.filter(F.col("last").isNull() | (F.col("place") >= F.col("last"))).select("term", "chunk_id", "doc_id", "positions")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """term, chunk_id, doc_id, positions as of now; of some terms, only their pages are read."""
        return self._current(self.state()[1], terms)

    def search(self, query: list[str], k: int) -> DataFrame:
        """chunk_id, text_rank of the k best chunks."""
        return retrieval.posted_top(self.postings(sorted(set(query))), query, k)

    def _write(self, name: int, place: int, rows: DataFrame, replaced: DataFrame) -> Part:
        at = f"{self.folder}/postings/{name}"
        rows.write.mode("overwrite").parquet(at)
        replaced.select("doc_id").write.mode("overwrite").parquet(f"{self.folder}/replaced/{name}")
        return Part(name, place, self.spark.read.schema(POSTINGS).parquet(at).count())  # from the files' footers

    def put(self, chunks: DataFrame, sources: DataFrame, cut: bool = False) -> None:
        """Replaces all postings of ``sources`` (doc_id) by those of ``chunks`` (chunk_id, doc_id, content), whose sources are among them.

        A source without chunks is deleted; a null doc_id is a source like any other; repeated ids count once; a null content has no postings.
        """
        state, parts = self.state()
        fresh = retrieval.posting_lists(chunks.select("chunk_id", F.col("doc_id").cast("long").alias("doc_id"), "content"), "doc_id")
        part = self._write(state + 1, state + 1, fresh.select("term", "chunk_id", "doc_id", "positions"), sources.select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
        if cut:
            raise Cut
        self._use(state + 1, [*parts, part])
        self._merge()

    def _merge(self) -> None:
        state, parts = self.state()
        low = len(parts) - 1
        while low > 0 and parts[low - 1].n_rows <= FANOUT * sum(p.n_rows for p in parts[low:]):
            low -= 1
        if len(parts) - low < FANOUT:
            return
        taken = parts[low:]
        # what the merged rows replace in earlier parts; before the first part there is nothing
        replaced = self._read(taken, "replaced", "doc_id long").select("doc_id").distinct() if low else self.spark.createDataFrame([], "doc_id long")
        part = self._write(state + 1, taken[-1].place, self._current(taken).sortWithinPartitions("term", "chunk_id"), replaced)
        self._use(state + 1, [*parts[:low], part])

    def vacuum(self) -> None:
        """Removes the parts that no longer are in use. Searches that began before may still read them: leave time for these."""
        state, parts = self.state()
        used = {p.name for p in parts}
        for name in range(1, state + 1):
            if name not in used:
                for table in ("postings", "replaced"):
                    removed(self.spark, f"{self.folder}/{table}/{name}")
