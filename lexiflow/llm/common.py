"""Shared pieces of the corpus operators: tables, shared folder, packed arrays, learning split."""

from __future__ import annotations

import uuid

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.session import checkpoint_root, ship_package

#: a word of every contract: a maximal run outside space, tab, LF, VT, FF and CR
WORD = r"[^\x20\x09-\x0D]+"
#: rank of a null id: after every other id
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The cluster's shuffle partition count, which grows with its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/lexiflow-llm/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one operator run; they go when its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{checkpoint_root(spark).rstrip('/')}/lexiflow-llm/scratch-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def remainder(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null for a null id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % mod


_Z = None


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of given types as one compressed blob."""
    global _Z
    if _Z is None:
        _Z = (zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor())
    head = np.array([a.nbytes for a in arrays], np.int64)
    return _Z[0].compress(b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    global _Z
    if _Z is None:
        _Z = (zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor())
    raw = _Z[1].decompress(blob)
    head = np.frombuffer(raw, np.int64, len(types))
    out, at = [], 8 * len(types)
    for n, t in zip(head, types):
        out.append(np.frombuffer(raw, t, int(n) // np.dtype(t).itemsize, at))
        at += int(n)
    return out


#: what this worker keeps from one task to the next, by owner
_KEPT: dict = {}


def kept(owner: str, of, make):
    """``make()``, made once for each ``of`` in a worker; what another owner kept goes."""
    if _KEPT.get("owner") != owner or _KEPT.get("of") is not of:
        _KEPT.clear()
        _KEPT.update(owner=owner, of=of, value=make())
    return _KEPT["value"]


def let_go() -> None:
    """First call of a task of an operator that keeps nothing: a reused worker gives back what an earlier one kept."""
    _KEPT.clear()
