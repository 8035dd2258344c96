"""Approximate nearest neighbours: inverted lists with an adaptive dimension scan.

1. Equal vectors are one entry that knows its six smallest ids (a map-side
   reduction first), so a vector that a third of the rows hold is searched, and found, once.
2. Lists: k-means on a bounded sample (``SAMPLE`` rows; every row is indexed).  Long
   lists are dealt over blocks of about ``BLOCK`` entries by a hash, so no task holds a list.
3. Vectors are normalised, rotated by a seeded orthogonal matrix, and scanned in blocks
   of ``COLUMNS`` columns.  After d of D columns the partial squared distance p estimates the whole as
   p * D / d; a candidate whose estimate lies above the current sixth-best distance times
   (1 + ``EPSILON`` / sqrt(d))**2 is abandoned: the hypothesis that it is nearer is rejected.
   What reaches the last column is scored exactly: cosine of the given vectors in double precision.
4. Every query probes ``probes`` lists, all their blocks; the best entries are merged, their
   ids expanded, and the query's own id left out.  Without a given number it is measured: one
   pass over all entries finds the exact neighbours of ``ASKED`` queries (all of them, if there are fewer),
   and as many lists are probed as hold ``COVERED`` of these neighbours.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part,
nor do vectors of another length than the most frequent; a null id takes no part; repeated rows (same id,
same vector) are one candidate; ties go to the smaller id; fewer candidates than
asked for gives all there are in the probed lists; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import partitions, written

SAMPLE, MAX_LISTS, BLOCK, COLUMNS, EPSILON = 20_000, 4096, 4096, 8, 2.1
#: queries whose exact neighbours say how many lists are probed, and the share of these neighbours the lists hold
ASKED, COVERED = 256, 0.97


def _rows(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    out: list[np.ndarray | None] = []
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(np.append(0, np.cumsum([len(x) if x.is_valid else 0 for x in column])))
    at = 0
    ok = np.asarray(column.is_valid())
    for good, n in zip(ok, size):
        v = values[at: at + n]
        at += n
        out.append(v if good and n and np.isfinite(v).all() and v.any() else None)
    return ok, out


def _distinct(keep: int):
    """(id, vector) -> (vector as doubles, length, its smallest ids), equal vectors of a task as one row."""
    def run(batches):
        seen: dict[bytes, list[int]] = {}

        def flush():
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array([len(k) // 8 for k in seen], pa.int32()),
                 pa.array(list(seen.values()), pa.list_(pa.int64()))], ["v", "dim", "ids"])
        for batch in batches:
            _, vectors = _rows(batch.column(1))
            for i, v in zip(batch.column(0).to_pylist(), vectors):
                if v is None or i is None:
                    continue
                ids = seen.setdefault((v + 0.0).tobytes(), [])
                if i not in ids:
                    ids.append(i)
                    if len(ids) > keep:
                        ids.remove(max(ids))
            if len(seen) > 50_000:
                yield from flush()
                seen.clear()
        yield from flush()
    return run


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors (spherical k-means); empty ones are dropped."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i: i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        n = np.linalg.norm(s, axis=1)
        c = s[n > 1e-12] / n[n > 1e-12, None]
    return c


def _unit(blobs: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(blobs), np.float64).reshape(-1, dim)
    big = np.abs(raw).max(1, keepdims=True)          # avoids overflow of squares
    n = np.linalg.norm(raw / big, axis=1)
    return raw, (raw / big) / n[:, None], n * big[:, 0]


def _exact(centroids, asked, dim: int, keep: int):
    """(did, v) -> (query, score, list): the best entries of a task for each sampled query, its own left out."""
    def run(batches):
        own, q = asked.value
        c = centroids.value
        score, where = np.full((len(q), keep), -np.inf), np.zeros((len(q), keep), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            did = batch.column(0).to_numpy()
            _, u, _ = _unit(batch.column(1).to_pylist(), dim)
            for i in range(0, len(u), 4096):
                x = u[i: i + 4096]
                s = q @ x.T
                s[own[:, None] == did[None, i: i + 4096]] = -np.inf
                s = np.concatenate([score, s], axis=1)
                at = np.concatenate([where, np.tile((x @ c.T).argmax(1), (len(q), 1))], axis=1)
                top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                score, where = np.take_along_axis(s, top, 1), np.take_along_axis(at, top, 1)
        ok = np.isfinite(score)
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(ok)[0].astype(np.int32)), pa.array(score[ok]),
                                          pa.array(where[ok].astype(np.int32))], ["q", "score", "list"])
    return run


def enough_probes(entry: DataFrame, asked: DataFrame, centroids, dim: int, k: int, seed: int) -> int:
    """The least number of lists that hold ``COVERED`` of the exact ``k`` nearest entries of the sampled queries."""
    some = (entry.join(asked.select("did").distinct(), "did", "left_semi").select("did", "v")
            .orderBy(F.xxhash64("v", F.lit(seed))).limit(ASKED).toPandas())
    if not len(some):
        return 1
    _, q, _ = _unit(some["v"].tolist(), dim)
    sent = entry.sparkSession.sparkContext.broadcast((some["did"].to_numpy(), q))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "list")
    true = (entry.select("did", "v").mapInArrow(_exact(centroids, sent, dim, k), "q int, score double, list int")
            .withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("q", "list").collect())   # ASKED * k rows at most
    if not true:
        return 1
    turn = (-(q @ centroids.value.T)).argsort(1).argsort(1)      # place of each list in the order of probing
    turns = sorted(int(turn[r.q, r.list]) for r in true)
    return turns[math.ceil(COVERED * len(turns)) - 1] + 1


def _assign(centroids, dim: int, probes: int):
    """(did, v, is query) -> (list, did, kind): an entry in its list (0), and a query in each probed list (1)."""
    def run(batches):
        c = centroids.value
        for batch in batches:
            if not batch.num_rows:
                continue
            did, query = batch.column(0).to_numpy(), np.asarray(batch.column(2))
            _, u, _ = _unit(batch.column(1).to_pylist(), dim)
            for i in range(0, len(u), 4096):
                near = u[i: i + 4096] @ c.T
                q = np.flatnonzero(query[i: i + 4096])
                p = min(probes, len(c))
                top = np.argpartition(-near[q], p - 1, axis=1)[:, :p] if len(q) else np.zeros((0, p), np.int64)
                lists = np.concatenate([near.argmax(1), top.ravel()])
                dids = np.concatenate([did[i: i + 4096], np.repeat(did[i: i + 4096][q], p)])
                kind = np.concatenate([np.zeros(len(near), np.int8), np.ones(top.size, np.int8)])
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(dids), pa.array(kind)],
                                                 ["list", "did", "kind"])
    return run


def scan(q: np.ndarray, x: np.ndarray, keep: int, columns: int = COLUMNS, epsilon: float = EPSILON) -> np.ndarray:
    """Rows of ``x`` (rotated unit vectors) that are not abandoned against ``q`` on the way to the last column.

    The first rows give the first bound: the ``keep``-th least whole distance among them.
    """
    dim = x.shape[1]
    head = min(len(x), 4 * keep)
    bound = np.sort(((x[:head] - q) ** 2).sum(1))[keep - 1] if head >= keep else math.inf
    alive = np.arange(len(x))
    part = np.zeros(len(x))
    for a in range(0, dim, columns):
        b = min(a + columns, dim)
        part = part + ((x[alive, a:b] - q[a:b]) ** 2).sum(1)
        if b < dim:
            ok = part * (dim / b) <= bound * (1 + epsilon / math.sqrt(b)) ** 2 + 1e-12
        else:
            ok = part <= bound + 1e-9
        alive, part = alive[ok], part[ok]
    return alive


def _search(dim: int, keep: int, seed: int):
    """Rows (list, block, kind, did, v, least id), sorted -> (query, did, score): each query's best in a block."""
    def run(batches):
        turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
        now, entries, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            cut = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1, [len(at)]]).tolist()
            for i, j in zip(cut[:-1], cut[1:]):
                if tuple(at[i]) != now:
                    now, entries, block = tuple(at[i]), [], None
                part = batch.slice(i, j - i)
                kind = part.column(2).to_numpy()
                n = int((kind == 0).sum())
                if n:
                    entries.append(part.slice(0, n))
                if n == len(kind):
                    continue
                if block is None:
                    if not entries:
                        continue
                    t = pa.Table.from_batches(entries)
                    raw, u, norm = _unit(t.column(4).to_pylist(), dim)
                    block = (t.column(3).to_numpy(), t.column(5).to_numpy(), raw, norm, u @ turn)
                dids, least, raw, norm, x = block
                part = part.slice(n)
                qraw, qu, qnorm = _unit(part.column(4).to_pylist(), dim)
                out_q, out_d, out_s = [], [], []
                for own, r, v, m in zip(part.column(3).to_pylist(), qraw, qu @ turn, qnorm):
                    k = scan(v, x, keep)
                    score = np.array([float(np.dot(r, raw[i])) / (m * norm[i]) for i in k])
                    best = np.lexsort((least[k], -score))[:keep]
                    out_q.append(np.full(len(best), own))
                    out_d.append(dids[k[best]])
                    out_s.append(score[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_d)),
                                                  pa.array(np.concatenate(out_s))], ["q", "did", "score"])
    return run


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, probes: int | None = None, id_col: str = "vec_id",
            vector_col: str = "embedding", seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each row whose id is divisible by ``every``.

    ``probes``: lists that a query looks into; None: as many as the sampled queries need.
    """
    spark = vectors.sparkSession
    n = partitions(spark)
    keep = k + 1
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("e"))
    each = own.mapInArrow(_distinct(keep), "v binary, dim int, ids array<long>")
    entry = written(each.groupBy("v", "dim").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
                                                 .alias("ids")).withColumn("did", F.monotonically_increasing_id()), "entries")
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # vectors of different lengths have no cosine: each length is a search of its own
    for dim, count in entry.groupBy("dim").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "dim").collect():
        found = found.unionByName(_nearest_of_length(own, entry.where(F.col("dim") == dim), dim, count, every, k, probes, seed))
    return found


def _nearest_of_length(own: DataFrame, entry: DataFrame, dim: int, count: int, every: int, k: int, probes: int | None, seed: int) -> DataFrame:
    spark, n, keep = own.sparkSession, partitions(own.sparkSession), k + 1
    # every query row, by entry (a query's id need not be among the smallest of its vector)
    asked = (own.where((F.col("id") % every) == 0).mapInArrow(_queries, "id long, v binary").distinct()
             .join(entry.select("v", "did"), "v").select("id", "did"))
    asked = written(asked, "asked")
    sample = (entry.select("v").orderBy(F.xxhash64("v", F.lit(seed))).limit(SAMPLE).toPandas())
    lists = int(min(MAX_LISTS, max(1, math.sqrt(count))))
    _, u, _ = _unit(sample["v"].tolist(), dim)
    centroids = spark.sparkContext.broadcast(kmeans(u, lists))
    if probes is None:
        probes = enough_probes(entry, asked, centroids, dim, k, seed)
    flagged = entry.join(asked.select("did").distinct().withColumn("query", F.lit(True)), "did", "left").select(
        "did", "v", F.coalesce("query", F.lit(False)).alias("query"))
    placed = written(flagged.mapInArrow(_assign(centroids, dim, probes), "list int, did long, kind byte"), "placed")
    blocks = placed.where("kind = 0").groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(F.broadcast(blocks), "list")      # a row per list: MAX_LISTS at most
    here = dealt.where("kind = 0").withColumn("block", F.pmod(F.xxhash64("did"), F.col("blocks")).cast("int"))
    there = dealt.where("kind = 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = here.select("list", "block", "kind", "did").unionAll(there.select("list", "block", "kind", "did"))
    rows = (rows.join(entry.select("did", "v", F.col("ids")[0].alias("least")), "did")
            .select("list", "block", "kind", "did", "v", "least")
            .repartition(n, "list", "block").sortWithinPartitions("list", "block", "kind"))
    found = rows.mapInArrow(_search(dim, keep, seed), "q long, did long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "least")
    found = (found.join(entry.select("did", "ids", F.col("ids")[0].alias("least")), "did")
             .withColumn("r", F.row_number().over(best)).where(F.col("r") <= keep)
             .select(F.col("q").alias("did"), "score", "ids"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asked.withColumnRenamed("id", "query_id").join(found, "did")
            .select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _queries(batches):
    for batch in batches:
        _, vectors = _rows(batch.column(1))
        got = [(i, (v + 0.0).tobytes()) for i, v in zip(batch.column(0).to_pylist(), vectors) if v is not None and i is not None]
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())],
                                         ["id", "v"])
