"""Near-duplicate documents: MinHash bands, Odd sketches, and confirmation on full sets.

1. Each document becomes its set of hashed word shingles: a digest of the set, band keys of MinHash
   samples, and an Odd sketch, a parity bitmap into which the samples are folded.
2. Equal sets are one class, known by its least id.
3. Classes that share a band hang on the least of the band; components of these edges are families,
   outside of which there is no candidate.
4. A family is compared in blocks of classes, never as one list of pairs. In a block, XOR population
   counts of the sketches estimate all similarities at once; pairs at or above the limit less
   `SLACK`, not yet known as connected, are confirmed on their full sets. Only links that connect
   something leave a block, at most one per class.
5. A family of more than one block is first compared within its blocks and with `PIVOTS` classes
   that all its blocks see. What those links connect needs no further look. Then each class outside
   of the family's largest component is compared with all blocks. So the work left grows with the
   exceptions, and no pair of unconnected candidates is left out.
6. Components of the confirmed links are the answer.

Null text or no words: empty set, linked with nothing. Null id: a row of its own. Rows with the same
id are one node. Ties go to the least id. Very long texts are read whole; a block holds `BLOCK_BYTES`
of them. Empty table: no rows. Only the id and text columns are read, so no others can clash; a
filtered table keeps all its columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import WordHash, claim, free_name, raw, ship, written
from skein.llm.graph import components

#: Bits of an Odd sketch; how far below the limit its estimate may lie; classes in a block; classes all blocks of a family see.
SKETCH_BITS, SLACK, BLOCK, PIVOTS = 512, 0.12, 384, 48
#: Text bytes that a block holds, and that its pivots have together, about, so that a block of very long texts stays small.
BLOCK_BYTES, PIVOT_BYTES = 8 << 20, 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_hashes = WordHash()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[2]
    x = (x ^ (x >> np.uint64(29))) * _MIX[0]
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """The sorted set of 64-bit hashes of k-word shingles; the whole sequence if there are fewer words."""
    words = text.lower().split() if text else []  # bytes.lower() changes A-Z alone
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    claim("minhash", _hashes)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=n)
    with np.errstate(over="ignore"):
        m = min(k, n)
        x = np.zeros(n - m + 1, dtype=np.uint64)
        for i in range(m):
            x = x * _MIX[0] + h[i : n - m + 1 + i] * _MIX[1]
        return np.unique(_mixed(x + np.uint64(m)))


def multipliers(samples: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, samples, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def sample(s: np.ndarray, by: np.ndarray) -> np.ndarray:
    """One MinHash sample for each multiplier; long sets go in stretches."""
    with np.errstate(over="ignore"):
        best = (s[:256, None] * by).min(0)
        for at in range(256, len(s), 256):
            np.minimum(best, (s[at : at + 256, None] * by).min(0), out=best)
    return best


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Each (place, sample) flips one bit."""
    with np.errstate(over="ignore"):
        at = _mixed(samples + np.arange(len(samples), dtype=np.uint64) * _MIX[1]) % np.uint64(bits)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def sketch_limit(similarity: float, samples: int, bits: int = SKETCH_BITS) -> int:
    """The most differing bits at which two sketches are held for similar: the estimate is 1 + bits/(4 samples) ln(1 - 2 z/bits)."""
    return int(bits / 2 * (1 - np.exp(4 * samples * (similarity - 1) / bits)))


def signatures(docs: DataFrame, doc_id: str, text: str, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key, bands (array of long), sketch, and size (bytes of the text)."""
    ship(docs.sparkSession)
    by = multipliers(bands * rows)

    @F.arrow_udf("struct<n_shingles:bigint,set_key:binary,bands:array<bigint>,sketch:binary,size:bigint>")
    def sign(texts: pa.Array) -> pa.Array:
        n, keys, band_keys, sketches, sizes = [], [], [], [], []
        for x in raw(texts):
            s = shingles(x, k)
            n.append(len(s))
            sizes.append(len(x or b""))
            if not len(s):
                keys.append(None)
                band_keys.append(None)
                sketches.append(None)
                continue
            m = sample(s, by)
            keys.append(xxhash.xxh3_128_digest(s.tobytes()))
            with np.errstate(over="ignore"):
                b = m.reshape(bands, rows)
                x = np.arange(bands, dtype=np.uint64) * _MIX[1]
                for j in range(rows):
                    x = _mixed(x + b[:, j])
            band_keys.append(x.view(np.int64))
            sketches.append(odd_sketch(m))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(band_keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(sizes, pa.int64())], names=["n_shingles", "set_key", "bands", "sketch", "size"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), sign(F.col(text)).alias("s")).select("doc_id", "text_key", "s.*")


class Joined:
    """Union-find over places."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self) -> np.ndarray:
        return np.fromiter((self.root(i) for i in range(len(self.up))), dtype=np.int64, count=len(self.up))

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def block_links(ids: list[int], labels: list[int], left: np.ndarray, texts: list[bytes], sketches: list[bytes], k: int, percent: int, most: int) -> list[tuple[int, int]]:
    """Confirmed links that connect what labels leave apart. left: which rows are compared with all rows."""
    n = len(ids)
    joined, first = Joined(n), {}
    for i, label in enumerate(labels):
        joined.join(first.setdefault(label, i), i)
    bitmap = np.frombuffer(b"".join(sketches), dtype=np.uint64).reshape(n, -1)
    sets: dict[int, np.ndarray] = {}

    def of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingles(texts[i], k)
        return sets[i]

    out = []
    for i in np.flatnonzero(left).tolist():
        apart = np.bitwise_count(bitmap ^ bitmap[i]).sum(1)
        near = np.flatnonzero(apart <= most)
        for j in near[np.argsort(apart[near], kind="stable")].tolist():
            if j == i or joined.root(i) == joined.root(j):
                continue
            a, b = of(i), of(j)
            if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= percent * (len(a) + len(b) - both):
                joined.join(i, j)
                out.append((ids[i], ids[j]))
    return out


def compare(rows: DataFrame, k: int, percent: int, samples: int) -> DataFrame:
    """rows: task, side (0 is compared with all, 1 only looked at), rep, label, text, sketch. Links (a, b) of each task."""
    most = sketch_limit(percent / 100 - SLACK, samples)

    def links(task: pa.Table) -> pa.Table:
        t = task.to_pydict()
        found = block_links(t["rep"], t["label"], np.array(t["side"]) == 0, t["text"], t["sketch"], k, percent, most)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.select("task", "side", "rep", "label", F.col("text").cast("binary").alias("text"), "sketch").groupBy("task").applyInArrow(links, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, bands: int = 32, rows: int = 6) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    samples = bands * rows
    signed = written(signatures(docs, doc_id, text, k, bands, rows), "signed")
    sets = signed.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    # grouped rows are written before they are joined back: only then can the join split a hot key
    classes = written(sets.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    members = written(sets.select("doc_id", "set_key").join(classes, "set_key").select("doc_id", "rep").distinct(), "members")
    reps = sets.join(classes.withColumnRenamed("rep", "doc_id"), ["set_key", "doc_id"], "left_semi").dropDuplicates(["set_key", "doc_id"]).select(F.col("doc_id").alias("rep"), "text_key", "bands", "sketch", "size")
    reps = written(reps, "reps")
    banded = reps.select("rep", F.explode("bands").alias("band"))
    least = written(banded.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high"), "bands")
    hung = banded.join(least, "band").filter("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
    families = written(components(hung, "families"), "families")
    links = _family_links(docs, doc_id, text, families, reps, k, percent, samples)
    # all members of a class are one: a link to its representative, and the confirmed links
    edges = links.union(members.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = components(edges, "links").withColumnRenamed("node", "doc_id")
    out = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _family_links(docs: DataFrame, doc_id: str, text: str, families: DataFrame, reps: DataFrame, k: int, percent: int, samples: int) -> DataFrame:
    of = families.select(F.col("node").alias("rep"), F.col("component").alias("family"))
    sizes = of.join(reps.select("rep", "size"), "rep").groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    every = F.greatest(F.lit(1), (F.col("n") / PIVOTS).cast("int"), F.ceil(F.col("bytes") / PIVOT_BYTES).cast("int"))
    sizes = written(sizes.select("family", blocks.alias("blocks"), every.alias("every")), "sizes")
    # only the texts of representatives with a family move
    whole = docs.select(F.col(doc_id).cast("long").alias("rep"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    placed = whole.join(of.join(sizes, "family").join(reps.select("rep", "text_key", "sketch"), "rep"), ["rep", "text_key"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = written(placed.select("family", "blocks", "every", "block", "rep", "text", "sketch"), "placed")
    # first: within blocks, and with the pivots that all blocks of the family see
    pivot = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("every")) == 0
    mine = placed.select(F.struct("family", "block", F.lit(-1).alias("other")).alias("task"), F.lit(0).alias("side"), "rep", F.col("rep").alias("label"), "text", "sketch")
    shown = placed.filter((F.col("blocks") > 1) & pivot).select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"), "block", "rep", "text", "sketch").filter("`to` <> block")
    shown = shown.select(F.struct("family", F.col("to").alias("block"), F.lit(-1).alias("other")).alias("task"), F.lit(1).alias("side"), "rep", F.col("rep").alias("label"), "text", "sketch")
    first = written(compare(mine.unionByName(shown), k, percent, samples), "links")
    large = placed.filter("blocks > 1")
    if not large.select("rep").head(1):
        return first
    # then: what is outside of the family's largest component, with all its blocks
    label = components(first, "first").withColumnRenamed("node", "rep")
    large = large.join(label, "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
    counted = large.groupBy("family", "label").agg(F.count("*").alias("m"))
    main = counted.groupBy("family").agg(F.max(F.struct("m", "label")).alias("x")).select("family", F.col("x.label").alias("main"))
    large = written(large.join(main, "family"), "large")
    rest = large.filter("label <> main")
    task = F.struct("family", F.col("block"), F.col("to").alias("other")).alias("task")
    asked = rest.select("family", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"), "rep", "label", "text", "sketch").filter("`to` <> block")
    pairs = rest.select("family", "block", "blocks").distinct().select("family", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to")).filter("`to` <> block")
    looked = pairs.join(large.select("family", F.col("block").alias("to"), "rep", "label", "text", "sketch"), ["family", "to"])
    second = compare(asked.select(task, F.lit(0).alias("side"), "rep", "label", "text", "sketch").unionByName(looked.select(task, F.lit(1).alias("side"), "rep", "label", "text", "sketch")), k, percent, samples)
    return first.union(written(second, "links"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one document of each group, the least id; rows that repeat an id stay or go together."""
    gone = near_duplicates(docs.select(doc_id, text), doc_id, text, **options).filter(~F.col("kept")).select(F.col("doc_id").alias(free_name(docs, "gone"))).distinct()
    gone = written(gone, "gone")
    key = gone.columns[0]
    small = gone.count() * 16 <= 8 << 20
    return docs.join(F.broadcast(gone) if small else gone, F.col(doc_id) == F.col(key), "left_anti")
