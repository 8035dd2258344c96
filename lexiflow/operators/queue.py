"""The queue of paid calls: waves dealt once, written one by one, each bound to its input by a manifest.

A paid stage reads a stored table of calls.  Its *fingerprint* (row count, sum of row hashes, size of a wave, and a
tag of the settings that shape a reply) names the run's folder::

    <table>/run-<fingerprint>/input/wave=K     the calls of wave K (only where there are several waves)
                              out/wave=K       its replies
                              commits/K.json   its manifest: rows and token sums, as observed by the write

* The calls are dealt to waves in one pass over them; a wave is read from its own folder, so all waves together read the
  dealt table once, however many there are.
* A wave counts as paid when its manifest is there.  A run that goes on (``resume``) pays for the others only.
* Another input has another fingerprint: replies to calls that are not in it are never read, whatever the folder holds.
* Rows, errors and tokens come from the write that paid for them (``DataFrame.observe``); nothing is read again to count them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.cost import cost_usd


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def write_whole(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written beside its place, then renamed."""
    fs, p = _fs(spark, path)
    _, beside = _fs(spark, path + ".part")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"can't commit {path}")


def fingerprint(calls: DataFrame, calls_per_wave: int, tag: str) -> tuple[int, str]:
    """Number of calls, and a name that another set of calls does not have."""
    row = calls.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*calls.columns).cast("decimal(38,0)")).alias("s")).first()
    said = f"{row.n}|{row.s}|{calls_per_wave}|{tag}|{calls.schema.simpleString()}"
    return row.n, hashlib.sha256(said.encode()).hexdigest()[:24]


@dataclass
class Wave:
    number: int
    rows: int
    input: DataFrame


class PaidQueue:
    """The waves of one paid stage.  ``calls``: a stored table (its evaluation is a read)."""

    def __init__(self, work, calls: DataFrame, name: str, key: list[str], calls_per_wave: int, tag: str = ""):
        self.work, self.spark, self.calls = work, calls.sparkSession, calls
        self.n, mark = fingerprint(calls, calls_per_wave, tag)
        self.mark, self.key, self.per_wave = mark, key, calls_per_wave
        self.name = f"{name}/run-{mark}"
        self.waves = max(1, -(-self.n // calls_per_wave))
        if not work.resume:
            remove(self.spark, work.table(self.name))

    def _commit_path(self, k: int) -> str:
        return self.work.table(f"{self.name}/commits/{k}.json")

    def committed(self) -> set[int]:
        fs, p = _fs(self.spark, self.work.table(f"{self.name}/commits"))
        if not fs.exists(p):
            return set()
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return {int(x[:-5]) for x in names if x.endswith(".json")}

    def _dealt(self) -> list[Wave]:
        if self.waves == 1:
            return [Wave(0, self.n, self.calls)]
        spark, table = self.spark, f"{self.name}/input"
        if not self.work.exists(table):
            wave = F.pmod(F.xxhash64(*self.key), F.lit(self.waves)).cast("int")
            files = max(1, self.per_wave // 10_000)          # a wave is written by so many tasks, whatever its number
            part = F.pmod(F.xxhash64(F.lit("file"), *self.key), F.lit(files))
            (self.calls.withColumn("wave", wave).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "wave", part)
             .write.partitionBy("wave").mode("overwrite").parquet(self.work.table(table)))
        stored = spark.read.parquet(self.work.table(table))
        rows = {r.wave: r.n for r in stored.groupBy("wave").agg(F.count(F.lit(1)).alias("n")).collect()}     # a row per wave
        return [Wave(k, rows[k], spark.read.schema(self.calls.schema).parquet(f"{self.work.table(table)}/wave={k}")) for k in sorted(rows)]

    def run(self, call: Callable[[DataFrame, int], DataFrame], conf: dict | None = None) -> DataFrame:
        """Pay for all open waves and return the replies to exactly these calls."""
        if self.spark.sparkContext.getConf().get("spark.speculation", "false") == "true":
            raise RuntimeError("spark.speculation must be off for paid calls: a speculative task would pay again")
        replies = call(self.calls, self.n)                    # a plan, for its schema
        if self.n == 0:
            return self.spark.createDataFrame([], replies.schema)
        paid = self.committed()
        waves = self._dealt()
        for w in waves:
            if w.number in paid:
                continue
            table = f"{self.name}/out/wave={w.number}"
            seen = Observation(f"wave-{w.number}")
            sums = [F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens")),
                    F.coalesce(F.sum((F.col("status") == "error").cast("int")), F.lit(0)).cast("bigint").alias("errors")]
            if self.work.resume and self.work.exists(table):  # written whole, but the driver was lost before the manifest
                got = self.spark.read.schema(replies.schema).parquet(self.work.table(table)).agg(*sums).first().asDict()
            else:
                self.work.materialize(call(w.input, w.rows).observe(seen, *sums), table, conf)
                got = seen.get
            write_whole(self.spark, self._commit_path(w.number), json.dumps({"fingerprint": self.mark, "wave": w.number, **got}))
        return self.spark.read.schema(replies.schema).parquet(self.work.table(f"{self.name}/out")).select(*replies.columns)

    def spent(self) -> DataFrame:
        """One row per paid wave from the manifests: wave, rows, input_tokens, output_tokens, errors."""
        schema = "fingerprint string, wave int, rows bigint, input_tokens bigint, output_tokens bigint, errors bigint"
        if not self.committed():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(self.work.table(f"{self.name}/commits")).where(F.col("fingerprint") == self.mark)

    def errors(self) -> int:
        """Calls that failed, from the manifests."""
        return self.spent().agg(F.sum("errors")).first()[0] or 0 if self.n else 0


def spent(queues: list[PaidQueue], settings: Settings = DEFAULT) -> DataFrame:
    """A8 from the manifests: calls, errors, tokens and dollars of the given queues, one row; no reply is read."""
    rows = queues[0].spent().select("rows", "errors", "input_tokens", "output_tokens")
    for q in queues[1:]:
        rows = rows.unionByName(q.spent().select("rows", "errors", "input_tokens", "output_tokens"))
    total = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("rows", "errors", "input_tokens", "output_tokens")))
    return total.withColumn("cost_usd", cost_usd("input_tokens", "output_tokens", settings))
