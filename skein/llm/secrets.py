"""Secrets: an incremental ledger of blobs. SQL functions only.

A version of a path is its text; its blob is the SHA-256 of it. The ledger holds, for each blob and
version of the rules, the findings. A run content-addresses all versions, leaves out the blobs that
the ledger has under the current rules, scans one text of each other blob, appends to the ledger
and joins the findings back to all paths and versions. A new version of the rules scans all anew.

Null text: empty, no findings; redacted it stays null. Empty text: no findings. Very long texts are
searched whole. Rows that agree in all keys: each has the same findings. Findings of one start go in
the order of the rules. Empty table: no rows. Extra columns are not looked at; redaction keeps them,
and the names it needs are chosen so that they do not clash.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from skein.llm.common import free_name, new_path, written
from skein.llm.spans import empty, find, listed, masked, of_kind

KINDS = ("assign", "access", "hex")
_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
#: Kind, pattern, a test that any match passes, and what a match must pass.
RULES = (
    ("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]+", r"(?i)password|passwd|secret|token|api_?key", 12),
    # A run too short has no longer one within it, so these two ask for the length at once: short runs are nearly every word.
    ("access", r"AKIA[A-Z0-9]{14,}", "AKIA", 18),
    ("hex", r"[0-9a-f]{16,}", r"[0-9a-f]{16}", 16),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY-----", 1),
    ("github", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+", "gh[pousr]_", 1),
    ("jwt", r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", r"eyJ.*\.eyJ", 1),
)
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
FINDINGS = "array<struct<start:int,k:int,kind:string,end:int>>"
LEDGER = f"blob string, rule_version string, findings {FINDINGS}"
#: Copies that are not scanned are broadcast up to this many bytes of keys; beyond, they are joined by shuffle.
MOST_BROADCAST, KEY_BYTES = 8 << 20, 96
#: Versions of one blob that one key holds when findings are joined back by shuffle.
HOT = 100_000


def _passes(head: str | None, least: int):
    """Whether a match, without what head matches of it, has the least length. (A lambda's second parameter would be an index.)"""
    return lambda s: F.length(F.regexp_replace(s["m"], head, "") if head else s["m"]) >= least


def scan_text(text: Column) -> Column:
    """Findings of all rules in a text, ordered by start and then rule."""
    found = []
    for k, (kind, pattern, there, least) in enumerate(RULES):
        spans = find(text, pattern, text.rlike(there))
        spans = F.filter(spans, _passes("^" + _ASSIGN if kind == "assign" else None, least))
        found.append(F.transform(of_kind(spans, kind, k), lambda s: F.struct(s["start"], s["k"], s["kind"], s["end"])))
    return F.array_sort(F.concat(*found))


def _seen(spark: SparkSession, ledger: str, rule_version: str) -> DataFrame | None:
    """Blobs that the ledger has under these rules; None where there is no ledger yet."""
    try:
        known = spark.read.schema(LEDGER).parquet(ledger)
        known.isEmpty()  # a client without a catalogue of its own notices a missing folder only here
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return known.filter(F.col("rule_version") == rule_version).select("blob").distinct()


def scan_versions(versions: DataFrame, ledger: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """One row per version: its keys, blob and findings. ledger: a folder, which may not yet be there; it is appended to."""
    spark = versions.sparkSession
    blob = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    rows = versions.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), blob.alias("blob"))
    rows = written(rows, "versions")
    names = [f"k{i}" for i in range(len(keys))]
    seen = _seen(spark, ledger, rule_version)
    # the version that stands for its blob is the one with the lowest hash of its keys: no text is needed to choose it
    place = F.xxhash64(*names).alias("p")
    chosen = rows.groupBy("blob").agg(F.min(place).alias("p"), F.count("*").alias("n"))
    if seen is not None:
        chosen = chosen.join(seen, "blob", "left_anti")
    chosen = written(chosen, "chosen")
    # what is not scanned: by blob and place, so that a blob of very many versions is many keys
    skipped = written(rows.select("blob", place).distinct().join(chosen.select("blob", "p"), ["blob", "p"], "left_anti"), "skipped")
    small = skipped.count() * KEY_BYTES <= MOST_BROADCAST
    whole = versions.select(blob.alias("blob"), F.xxhash64(*keys).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    todo = whole.join(F.broadcast(skipped) if small else skipped, ["blob", "p"], "left_anti")
    new = todo.select("blob", F.lit(rule_version).alias("rule_version"), scan_text(F.col("text")).alias("findings")).dropDuplicates(["blob"])
    new.write.mode("append").parquet(ledger)
    now = spark.read.schema(LEDGER).parquet(ledger).filter((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).dropDuplicates(["blob"])
    now = written(now.join(rows.select("blob").distinct(), "blob", "left_semi").select("blob", "findings"), "findings")
    found = joined_back(rows, now, written(rows.groupBy("blob").agg(F.count("*").alias("n")).filter(F.col("n") > HOT), "hot"))
    return found.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), "blob", F.coalesce("findings", empty(FINDINGS)).alias("findings"))


def joined_back(rows: DataFrame, found: DataFrame, hot: DataFrame) -> DataFrame:
    """rows left join found (blob, findings): by broadcast where that is small; else the rows of hot blobs (blob, n) are dealt to many keys."""
    size = found.agg(F.coalesce(F.sum(F.size("findings") * 32 + KEY_BYTES), F.lit(0))).first()[0]
    if size <= MOST_BROADCAST:
        return rows.join(F.broadcast(found), "blob", "left")
    # at most one hot blob for each HOT rows
    parts = hot.select("blob", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(parts), "blob", "left").withColumn("part", F.pmod(F.xxhash64(*rows.columns), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = found.join(F.broadcast(parts), "blob", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies, ["blob", "part"], "left").drop("part")


def secret_digests(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    found = scan_versions(docs, ledger or new_path(docs.sparkSession, "ledger"))
    base = F.filter("findings", lambda s: s["kind"].isin(*KINDS))
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", ledger: str | None = None) -> DataFrame:
    """docs with each secret in its text masked; a column n_chars follows the text."""
    spark = docs.sparkSession
    blob, found, row = free_name(docs, "version_blob"), free_name(docs, "version_findings"), free_name(docs, "version_row")
    # a version is told from its copies by its other columns; those that are equal in all of them are scanned once each
    others = [F.col(f"`{f.name}`") for f in docs.schema if f.name != text and isinstance(f.dataType, AtomicType)]
    keyed = docs.withColumn(blob, F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).withColumn(row, F.xxhash64(*others, F.lit(0)))
    hits = scan_versions(keyed, ledger or new_path(spark, "ledger"), (row, blob), text).filter(F.size("findings") > 0)
    hits = written(hits.select(F.col(blob), F.col("findings").alias(found)).dropDuplicates([blob]), "hits")
    small = hits.agg(F.coalesce(F.sum(F.size(found) * 32 + KEY_BYTES), F.lit(0))).first()[0] <= MOST_BROADCAST
    joined = keyed.join(F.broadcast(hits) if small else hits, blob, "left")
    clean = F.when(F.col(found).isNotNull(), masked(F.col(text), F.col(found), mark)).otherwise(F.col(text))
    out = joined.withColumn(text, clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(found).isNotNull(), F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
