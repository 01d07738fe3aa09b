"""Near-duplicate vectors by NN-descent.

1. Equal vectors are one class with a weight, known by the least id.
2. A first neighbour graph comes from leaves of random-hyperplane codes: `tables` codes, whose length
   follows the number of vectors; a code that more vectors share than a leaf holds is lengthened by
   further hyperplanes, and what still shares one is dealt to several leaves.
3. Descent: around each vector stand its neighbours and those it is a neighbour of (the nearest
   `neighbours` of each). All of these are compared with each other, and each keeps its nearest.
   A leaf and a centre offer a vector its `NEAREST` of them.
4. Edges at the threshold give components. A list that holds `NEAREST` links is saturated: others may
   have been cut off. A link with an unsaturated end is in that end's list, so saturated vectors are
   searched once more among themselves, for neighbours outside of their own component: its members
   take no place in the enlarged lists. Components that link are one; this goes on with new leaves
   until it finds nothing.
5. Each component is compared with itself in blocks of vectors. There all cosines are taken in double
   precision, links are counted, and only links that connect something are put out.
6. An audit holds a bounded sample against all vectors; while fewer than `recall` of the sampled
   vectors with links have all of these in their component, more tables and a descent with longer
   lists follow. After the last of `rounds`, all blocks are compared. What was found goes to the log.

Work of step 5 grows with the square of a component's size in different vectors, as its link counts
are asked for; it is dealt to as many tasks.

Vectors that are null, empty, zero, or hold null or non-finite components, and null ids, link with
nothing. Vectors of different lengths never link. Rows with one id are one node: its links are the
most that one of its vectors has, its component that of all of them. Of equally near neighbours the
least id comes first. Empty table: no rows. Other columns are not looked at, so they cannot clash.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import ship, written
from skein.llm.graph import components

LEAF, TABLES, NEIGHBOURS, BLOCK = 64, 12, 8, 512
#: Nearest that a leaf or a centre gives to a vector. A list with fewer links has had none cut off.
NEAREST = 4
#: Audited vectors: their number bounds what reaches the driver and what is sent to the executors.
AUDIT, RECALL, ROUNDS = 512, 0.98, 4
_SEARCH_SLACK = 1e-4
#: Rounds in which saturated vectors look beyond their components, and further hyperplanes of a code.
APART_ROUNDS, TAIL = 12, 30
#: Bytes of counts up to which they are broadcast.
MOST_BROADCAST = 8 << 20
log = logging.getLogger(__name__)


def _packed(batch_column: pa.Array) -> list[np.ndarray | None]:
    """Vectors as double arrays; None for those that can't link."""
    out = []
    for x in batch_column:
        v = x.values if x.is_valid else None
        if v is None or not len(v) or v.null_count:
            out.append(None)
            continue
        a = v.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(a).max()
        out.append(a if np.isfinite(a).all() and top > 0 else None)
    return out


def _unit(a: np.ndarray) -> np.ndarray:
    """Scaled first, so that very large and very small components do not overflow."""
    a = a / np.abs(a).max(axis=-1, keepdims=True)
    return a / np.sqrt((a * a).sum(axis=-1, keepdims=True))


def _vectors(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, key (digest of the vector), dim, unit (doubles as bytes), x (the same in single precision); key is null where nothing can link."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = _packed(batch.column(1))
            units = [None if v is None else _unit(v).tobytes() for v in vs]
            keys = [None if u is None else xxhash.xxh3_128_digest(u) for u in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array([0 if v is None else len(v) for v in vs], pa.int32()), pa.array(units, pa.binary()), pa.array([None if u is None else np.frombuffer(u).astype(np.float32).tobytes() for u in units], pa.binary())], names=["id", "key", "dim", "unit", "x"])

    return rows.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e")).mapInArrow(prepare, "id long, key binary, dim int, unit binary, x binary")




def _leaves(reps: DataFrame, n: int, tables: range, apart: float | None = None) -> DataFrame:
    """u, v, sim: each vector's nearest in each of its leaves; with `apart`, of those of another component at least so near. reps: id, dim, x, component."""
    bits = max(1, int(np.ceil(np.log2(max(2, n / LEAF)))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            ids, dims = batch.column(0), batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(batch.column(2).take(pa.array(at)).to_pylist()), dtype=np.float32).reshape(len(at), dim)
                own, label = ids.take(pa.array(at)), batch.column(3).take(pa.array(at))
                for t in tables:
                    if (t, dim) not in planes:
                        planes[t, dim] = np.random.default_rng([t, dim]).normal(size=(dim, bits + TAIL)).astype(np.float32)
                    side = (x @ planes[t, dim]) > 0
                    c = side[:, :bits] @ (1 << np.arange(bits, dtype=np.int64))
                    tail = side[:, bits:] @ (1 << np.arange(TAIL, dtype=np.int64))
                    keys = c + (np.int64(t) << 32) + (np.int64(dim) << 42)
                    yield pa.RecordBatch.from_arrays([own, label, pa.array(keys), pa.array(tail)], names=["u", "component", "code", "tail"])

    # codes are few bytes; the vectors themselves move once, when the leaves are known
    coded = written(reps.select("id", "dim", "x", "component").mapInArrow(code, "u long, component long, code long, tail long"), "codes")
    # counted rows are written before they are joined back: only then can the join split a hot code
    sizes = _counted(coded.groupBy("code").agg(F.count("*").alias("n")).filter(F.col("n") > LEAF).select("code", F.least(F.lit(TAIL), F.ceil(F.log2(F.col("n") / LEAF))).cast("int").alias("more")), "codes-n")
    longer = coded.join(sizes, "code", "left").withColumn("tail", F.col("tail").bitwiseAND(F.expr("shiftleft(1L, coalesce(more, 0)) - 1"))).drop("more")
    sizes = _counted(longer.groupBy("code", "tail").agg(F.count("*").alias("n")).select("code", "tail", F.ceil(F.col("n") / LEAF).alias("parts")).filter("parts > 1"), "tails-n")
    leaf = longer.join(sizes, ["code", "tail"], "left").withColumn("part", F.pmod(F.xxhash64("u", "code"), F.coalesce("parts", F.lit(1)))).drop("parts")
    leaf = leaf.join(reps.select(F.col("id").alias("u"), "x"), "u")
    # many leaves to a group, so that small ones do not each cost a call
    leaf = leaf.withColumn("group", F.pmod(F.xxhash64("code", "tail", "part"), F.lit(max(16, n * len(tables) // 4000))))

    def nearest(t: pa.Table) -> pa.Table:
        code, tail, part, u, label = (t[c].to_numpy() for c in ("code", "tail", "part", "u", "component"))
        order = np.lexsort((u, part, tail, code))
        cuts = np.flatnonzero((np.diff(code[order]) != 0) | (np.diff(tail[order]) != 0) | (np.diff(part[order]) != 0)) + 1
        rows, a, b, s = t["x"].to_pylist(), [], [], []
        for at in np.split(order, cuts):
            if len(at) < 2:
                continue
            x = np.frombuffer(b"".join([rows[i] for i in at]), dtype=np.float32).reshape(len(at), -1)
            sim = x @ x.T
            np.fill_diagonal(sim, -2)
            if apart is not None:
                sim[label[at][:, None] == label[at]] = -2
            k = min(NEAREST, len(at) - 1)
            best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            value = np.take_along_axis(sim, best, 1)
            i, j = np.nonzero(value >= (-1.5 if apart is None else apart))
            a.append(u[at][i])
            b.append(u[at][best[i, j]])
            s.append(value[i, j])
        return _edges(a, b, s)

    return leaf.select("group", "code", "tail", "part", "u", "component", "x").groupBy("group").applyInArrow(lambda t: nearest(t), "u long, v long, sim float")


def _counted(sizes: DataFrame, name: str) -> DataFrame:
    """sizes written, and broadcast where they are few."""
    sizes = written(sizes, name)
    return F.broadcast(sizes) if sizes.count() * 24 <= MOST_BROADCAST else sizes


def _edges(a: list, b: list, s: list) -> pa.Table:
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
    return pa.table({"u": join(a, np.int64), "v": join(b, np.int64), "sim": join(s, np.float32)})


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    best = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return best.withColumn("r", rank).filter(F.col("r") <= k)


def _descend(graph: DataFrame, reps: DataFrame, n: int, k: int) -> DataFrame:
    """Edges found among neighbours of neighbours."""
    back = graph.select(F.col("v").alias("c"), F.col("u").alias("m"), F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u")).alias("q")).filter(F.col("q") <= k).drop("q")
    around = graph.select(F.col("u").alias("c"), F.col("v").alias("m")).union(back).union(graph.select(F.col("u").alias("c"), F.col("u").alias("m"))).distinct()
    low = graph.groupBy("u").agg(F.min("sim").alias("low"), F.count("*").alias("n")).select(F.col("u").alias("m"), F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(-1.0)).cast("float").alias("low"))
    small = reps.select(F.col("id").alias("m"), "x").join(low, "m")
    group = F.pmod(F.xxhash64("c"), F.lit(max(16, n // 400))).alias("group")

    def local(t: pa.Table) -> pa.Table:
        c, m, low = t["c"].to_numpy(), t["m"].to_numpy(), t["low"].to_numpy()
        order = np.argsort(c, kind="stable")
        rows, a, b, s = t["x"].to_pylist(), [], [], []
        for at in np.split(order, np.flatnonzero(np.diff(c[order])) + 1):
            if len(at) < 2:
                continue
            x = np.frombuffer(b"".join([rows[i] for i in at]), dtype=np.float32).reshape(len(at), -1)
            sim = x @ x.T
            np.fill_diagonal(sim, -2)
            most = min(NEAREST, len(at) - 1)
            best = np.argpartition(-sim, most - 1, axis=1)[:, :most]
            value = np.take_along_axis(sim, best, 1)
            i, j = np.nonzero(value > low[at][:, None])
            a.append(m[at][i])
            b.append(m[at][best[i, j]])
            s.append(value[i, j])
        return _edges(a, b, s)

    joined = around.join(small, "m").select(group, "c", "m", "low", "x")
    return joined.groupBy("group").applyInArrow(lambda t: local(t), "u long, v long, sim float")


def _joined(near: DataFrame, reps: DataFrame, found: DataFrame, k: int, limit: float, tables: range) -> DataFrame:
    """found (node, component) with components made one where saturated vectors of them link."""
    saturated = near.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("links")).filter(F.col("links") >= min(NEAREST, k)).select("id")
    saturated = written(reps.select("id", "dim", "x").join(saturated, "id", "left_semi").join(found.withColumnRenamed("node", "id"), "id"), "saturated")
    n = saturated.count()
    for i in range(APART_ROUNDS if n else 0):
        start = tables.start + i * len(tables)
        links = _leaves(saturated, n, range(start, start + len(tables)), limit - _SEARCH_SLACK)
        # only which components link is needed of them
        pairs = links.join(found.toDF("u", "a"), "u").join(found.toDF("v", "b"), "v").select("a", "b").distinct()
        pairs = written(pairs, "apart")
        if pairs.isEmpty():
            break
        merged = written(components(pairs, "apart"), "merged").toDF("component", "into")
        relabel = lambda df: df.join(merged, "component", "left").withColumn("component", F.coalesce("into", "component")).drop("into")
        found = written(relabel(found).select("node", "component"), "joined")
        saturated = written(relabel(saturated).select("id", "dim", "x", "component"), "saturated")
    return found


def _exact(found: DataFrame, reps: DataFrame, n: int, limit: float) -> tuple[DataFrame, DataFrame]:
    """found: node, component. Per vector and block pair its number of links (u, n), and links that connect (a, b)."""
    sizes = written(found.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    placed = found.join(sizes, "component").join(reps.select(F.col("id").alias("node"), "unit", "weight"), "node")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    # small components share calls, of about a block together: `pack` is the component itself where it has several blocks
    many, packs = F.col("blocks") > 1, max(16, -(-n // BLOCK))
    rows = placed.select("component", "block", "node", "unit", "weight", "blocks", other).select(F.when(many, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(packs))).alias("pack"), F.when(many, F.least("block", "other")).otherwise(F.lit(-1)).alias("lo"), F.greatest("block", "other").alias("hi"), "component", "block", "node", "unit", "weight")

    def count(t: pa.Table) -> pa.Table:
        comp, node, weight, block = (t[c].to_numpy() for c in ("component", "node", "weight", "block"))
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        order = np.lexsort((node, comp))
        rows, u, n, a, b = t["unit"].to_pylist(), [], [], [], []
        for at in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            x = np.frombuffer(b"".join([rows[i] for i in at]), dtype=np.float64).reshape(len(at), -1)
            near = (x @ x.T) >= limit
            np.fill_diagonal(near, False)
            if lo != hi and lo >= 0:  # pairs within a block are counted where the block meets itself
                near &= block[at][:, None] != block[at][None, :]
            u.append(node[at])
            n.append(near @ weight[at])
            label = np.arange(len(at))
            for start in range(len(at)):  # a breadth-first tree for each component
                if label[start] != start:
                    continue
                seen = np.zeros(len(at), bool)
                seen[start], front = True, np.array([start])
                while len(front):
                    hit = near[front] & ~seen
                    new = np.flatnonzero(hit.any(0))
                    a.extend(node[at][new].tolist())
                    b.extend(node[at][front[hit[:, new].argmax(0)]].tolist())
                    seen[new], label[new], front = True, start, new
        kinds = np.concatenate([np.concatenate(n), np.array(b, dtype=np.int64)]) if b else np.concatenate(n)
        first = np.concatenate([np.concatenate(u), np.array(a, dtype=np.int64)]) if a else np.concatenate(u)
        return pa.table({"a": first.astype(np.int64), "b": kinds.astype(np.int64), "edge": pa.array([False] * (len(first) - len(a)) + [True] * len(a))})

    out = written(rows.groupBy("pack", "lo", "hi").applyInArrow(lambda t: count(t), "a long, b long, edge boolean"), "counted")
    return out.filter(~F.col("edge")).groupBy(F.col("a").alias("u")).agg(F.sum("b").alias("n")), out.filter("edge").select("a", "b")


def _audit(reps: DataFrame, found: DataFrame, limit: float, most: int) -> tuple[float | None, int]:
    """Of the sample's vectors with links, by brute force over all vectors: the share that has all of these in its component, and their number. None without any."""
    sample = reps.orderBy(F.xxhash64("id"), "id").limit(most).select("id", "dim", "unit").collect()
    ids, dims = np.array([r["id"] for r in sample], dtype=np.int64), np.array([r["dim"] for r in sample])
    own = {d: (ids[dims == d], np.stack([np.frombuffer(r["unit"], dtype=np.float64) for r in sample if r["dim"] == d])) for d in set(dims.tolist())}

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for dim, (names, x) in own.items():
                at = np.flatnonzero(d == dim)
                if len(at):
                    y = np.frombuffer(b"".join(batch.column(2).take(pa.array(at)).to_pylist()), dtype=np.float64).reshape(len(at), dim)
                    p, q = np.nonzero(y @ x.T >= limit)
                    keep = i[at][p] != names[q]
                    yield pa.RecordBatch.from_arrays([pa.array(i[at][p][keep]), pa.array(names[q][keep])], names=["a", "b"])

    truth = reps.select("id", "dim", "unit").mapInArrow(hold, "a long, b long")
    x, y = found.toDF("a", "ca"), found.toDF("b", "cb")
    # per vector: one in a large group counts as much as one of a pair
    whole = truth.join(x, "a", "left").join(y, "b", "left").groupBy("b").agg(F.min(F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).cast("int")).alias("whole"))
    r = whole.agg(F.avg("whole").alias("share"), F.count("*").alias("n")).first()
    return r["share"], r["n"]


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", limit: float = 0.95, tables: int = TABLES, neighbours: int = NEIGHBOURS, recall: float = RECALL, audit: int = AUDIT, rounds: int = ROUNDS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    The frame's `audited` is the last audit: the share of audited vectors with links that had all of
    them in their component, or None if none of them had a link, and how many had.
    """
    ship(rows.sparkSession)
    all_rows = written(_vectors(rows, vec_id, embedding), "vectors")
    good = all_rows.filter(F.col("key").isNotNull() & F.col("id").isNotNull())
    classes = written(good.groupBy("key").agg(F.min("id").alias("least"), F.count_distinct("id").alias("weight")), "classes")
    # a class goes by its least id; further classes of an id that is repeated with other vectors by a hash
    order = F.row_number().over(Window.partitionBy("least").orderBy("key"))
    classes = classes.withColumn("r", order).select("key", "least", "weight", F.when(F.col("r") == 1, F.col("least")).otherwise(F.xxhash64("key")).alias("rep"), F.col("r"))
    classes = written(classes, "classes")
    repeated = not classes.filter("r > 1").isEmpty()
    members = written(good.select("id", "key").join(classes, "key").select("id", "rep", "weight").distinct(), "members")
    reps = good.join(classes.withColumnRenamed("least", "id"), ["key", "id"]).select(F.col("rep").alias("id"), "dim", "unit", "x", "weight").dropDuplicates(["id"])
    reps = written(reps, "reps")
    n = reps.count()
    plain = reps.withColumn("component", F.col("id"))
    graph, k, share, held = None, neighbours, None, 0
    for i in range(rounds):
        more = _leaves(plain, n, range(i * tables, (i + 1) * tables) if i == 0 else range(i * tables, i * tables + tables // 2))
        graph = written(_nearest(more if graph is None else graph.select("u", "v", "sim").union(more), k), "graph")
        graph = written(_nearest(graph.select("u", "v", "sim").union(_descend(graph, reps, n, k)), k), "graph")
        near = graph.filter(F.col("sim") >= limit - _SEARCH_SLACK).select(F.col("u").alias("a"), F.col("v").alias("b"))
        found = written(components(near, "near"), "near")
        found = _joined(near, reps, found, k, limit, range(100 * (i + 1), 100 * (i + 1) + tables // 2))
        share, held = _audit(reps, found, limit, audit)
        log.info("round %d: %s of %d audited vectors with links have all of them in their component", i + 1, share, held)
        if share is None or share >= recall:
            break
        k *= 2
    else:  # the search finds too little: each two vectors of one length are compared
        log.warning("recall stayed below %s: all blocks are compared", recall)
        found = reps.select(F.col("id").alias("node"), F.col("dim").cast("long").alias("component"))
    links, connect = _exact(found, reps, n, limit)
    edges = connect.union(members.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    label = components(edges, "linked")
    if repeated:  # hashes stand for classes, not for ids: the least id of each component is looked up
        label = written(label, "label")
        least = label.join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi").groupBy("component").agg(F.min("node").alias("least"))
        label = label.join(written(least, "least"), "component").select("node", F.col("least").alias("component"))
    mine = members.join(links.withColumnRenamed("u", "rep"), "rep", "left").groupBy("id").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = all_rows.select("id").join(mine, "id", "left").join(label.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
    out.audited = share, held
    return out
