"""What the operators share: the shared folder, written tables, shipping, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import shipping

#: Arrow batches end at this many bytes, so that very long texts do not add up.
BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only in local mode, where all are one machine, an own one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc_dir = spark.sparkContext.getCheckpointDir()
        if sc_dir:
            return sc_dir
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext.getCheckpointDir() or found
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


_paths: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: it cuts the lineage, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more. A client without a file system of its own leaves them."""
    for t in tables:
        path = getattr(t, "written_at", None)
        jvm = getattr(t.sparkSession, "_jvm", None)
        if path and jvm is not None:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written within are removed at its end, but those that the function it gives was called with."""
    start, kept = len(_paths), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.written_at)
        return table

    yield keep
    gone, _paths[start:] = [p for p in _paths[start:] if p not in kept], [p for p in _paths[start:] if p in kept]
    for p in gone:
        t = spark.range(0)
        t.written_at = p
        discard(t)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, and bound Arrow batches by bytes, unless the session has its own bound."""
    if not spark.conf.get(_BATCH, None):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    shipping.ship(spark)


def raw(texts: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The texts as UTF-8 bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.cast(pa.large_binary()).to_pylist()


_held: dict[str, tuple] = {}


def claim(owner: str, *memories: dict) -> None:
    """From now on this worker remembers words for owner; what it held for others is cleared, so that memories of several operators never add up."""
    if owner not in _held:
        for other in list(_held):
            for m in _held.pop(other):
                m.clear()
    _held[owner] = memories


class WordHash(dict):
    """Word (bytes) to a 64-bit hash; forgets all words at `most` of them."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, so that extra columns cannot clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
