"""Secret scanning over an incremental blob ledger, in DataFrame operations only.

Every historical version of every path is content-addressed by SHA-256. A ledger
holds the (blob, rule, rule version) pairs that have been scanned with what was
found. A run scans only the pairs that the ledger lacks, each distinct blob once,
and joins the findings back to every path and version with that content.

Defined cases: a null text is the empty text; an empty text has no findings and
still enters the ledger; equal rows each get their own result row; a null path or
version is kept; an empty table gives an empty result; only the named columns are
read, so further columns with any name are harmless; texts are scanned whole, however
long; a ledger that holds a pair twice gives its findings once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import written

SALTS = 16  # tasks that the copies of one blob are dealt over


@dataclass(frozen=True)
class Rule:
    """``group``'s text must have ``least`` characters, or the match is dropped."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules of the contract, in its order, and the added ones.
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),  # maximal runs, so the bound may stand in the pattern
)
ADDED_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)
RULES = BASE_RULES + ADDED_RULES

LEDGER_SCHEMA = "blob string, rule string, rule_version int, spans array<struct<start:int,end:int>>"


def _matches(rule: Rule) -> Column:
    """array<struct<gap, size, kept>>: the characters before each match since the last one, its length, whether it counts."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    whole, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    judged = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    return F.transform(
        F.arrays_zip(whole.alias("m"), judged.alias("g"), F.slice(gaps, 1, F.size(whole)).alias("gap")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("size"), (F.length(x["g"]) >= rule.least).alias("kept")),
    )


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blobs (blob, text, todo: rule keys) -> ledger rows, one for each blob and rule to do, clean ones included."""
    each = F.array(
        *(
            F.when(
                F.array_contains("todo", rule.key),
                F.struct(
                    F.lit(rule.kind).alias("rule"),
                    F.lit(rule.version).alias("rule_version"),
                    F.when(F.col("text").rlike(rule.pattern), _matches(rule)).alias("found"),
                ),
            )
            for rule in rules
        )
    )
    scanned = blobs.select("blob", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("blob", "x.rule", "x.rule_version", F.posexplode_outer("x.found").alias("i", "m"))
    # the end of a match is the sum of all gaps and matches up to it; a partition holds one text's matches of one rule
    upto = Window.partitionBy("blob", "rule", "rule_version").orderBy("i")
    placed = scanned.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(upto).cast("int"))
    span = F.when(F.col("m.kept"), F.struct((F.col("end") - F.col("m.size")).alias("start"), F.col("end").alias("end")))
    return placed.groupBy("blob", "rule", "rule_version").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def _hashed(versions: DataFrame) -> DataFrame:
    return versions.select("path", "version", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


def _key() -> Column:
    return F.concat_ws("@", "rule", F.col("rule_version").cast("string"))


def scan_unseen(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger rows to append: each blob of versions (path, version, text) by each rule that the ledger lacks for it."""
    wanted = F.array(*(F.lit(r.key) for r in rules))
    blobs = _hashed(versions).select("blob", "text").dropDuplicates(["blob"])  # combined before the shuffle: copies travel once a task
    if ledger is None:
        blobs = blobs.withColumn("todo", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(_key()).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("todo") > 0)
    return scan_blobs(blobs.select("blob", "text", "todo"), rules)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row (path, version, blob, found: array<struct<start, ord, rule, end>> by start and rule) for every row of versions.

    A pair that a ledger holds twice counts once. Copies of one blob are dealt over `SALTS` tasks.
    """
    order = F.array_position(F.array(*(F.lit(r.kind) for r in rules)), F.col("rule")).cast("int")
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order.alias("ord"), F.col("rule").alias("rule"), s["end"].alias("end")))
    by_blob = (
        ledger.filter(_key().isin([r.key for r in rules]) & (F.size("spans") > 0))
        .dropDuplicates(["blob", "rule", "rule_version"])
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("found"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = _hashed(versions).select("path", "version", "blob", F.pmod(F.xxhash64("path", "version"), F.lit(SALTS)).cast("int").alias("salt"))
    none = F.array().cast("array<struct<start:int,ord:int,rule:string,end:int>>")
    return salted.join(by_blob, ["blob", "salt"], "left").select("path", "version", "blob", F.coalesce("found", none).alias("found"))


def scan_versions(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scans versions against a ledger -> (their findings, the fresh ledger rows), which are written first."""
    fresh = written(scan_unseen(versions, rules, ledger), "ledger")
    known = fresh if ledger is None else fresh.unionByName(ledger.select(*fresh.columns))
    return findings(versions, known, rules), fresh


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _equals(value: str):
    return lambda x: x == value


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    """Every document as one version of one path, that arrive in two runs over one ledger.

    The first run scans half of the paths, by hash, and writes its ledger; the second scans those blobs of
    the others that the ledger lacks; the findings of both are joined back to all paths.
    """
    from quillmesh.llm.common import table

    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text")
    early = F.pmod(F.xxhash64("path"), F.lit(2)) == 0
    ledger = written(scan_unseen(versions.filter(early)), "ledger")
    ledger = ledger.unionByName(written(scan_unseen(versions.filter(~early), ledger=ledger), "ledger"))
    kinds = [r.kind for r in BASE_RULES]
    base = F.filter("found", lambda x: x["rule"].isin(kinds))
    counts = [F.size(F.filter(F.transform("found", lambda x: x["rule"]), _equals(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return findings(versions, ledger).select(F.col("path").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _oracle() -> str:
    def sql(s: str) -> str:
        return s.replace("'", "''")

    legs = " UNION ALL ".join(
        f"SELECT rid, doc_id, '{r.kind}' AS kind, {k} AS ord, regexp_split_to_array(t, '{sql(r.pattern)}') AS gaps, regexp_extract_all(t, '{sql(r.pattern)}', 0) AS ms, regexp_extract_all(t, '{sql(r.pattern)}', {r.group}) AS gs, {r.least} AS least FROM d"
        for k, r in enumerate(RULES)
    )
    base = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({legs}),
pos AS (SELECT rid, kind, ord, i, length(gaps[i]) + length(ms[i]) AS step, length(ms[i]) AS size, length(gs[i]) >= least AS kept FROM raw, unnest(range(1, len(ms) + 1)) AS u(i)),
ends AS (SELECT *, sum(step) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM pos),
spans AS (SELECT rid, kind, ord, CAST(e - size AS BIGINT) AS s, kind || ':' || CAST(e - size AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM ends WHERE kept),
agg AS (SELECT rid, {counts}, string_agg(span, ',' ORDER BY s, ord) FILTER (WHERE kind IN ({base})) AS base, string_agg(span, ',' ORDER BY s, ord) AS spans FROM spans GROUP BY rid)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (rid)"""


OP8_ORACLE = _oracle()
