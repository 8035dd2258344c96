"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A document's set is its distinct 5-word shingles (A-Z lower-cased; with fewer
words, the whole sequence as one).  Documents link at
100 * intersection >= 75 * union, confirmed on the full sets.

1. *Classes.*  Equal sets (two 64-bit sums and the size) are one class, its id the
   least id.  From here on only classes count.
2. *Signatures.*  ``HASHES`` = 64 minima.  A pair at similarity 0.75 differs in 16
   of them on average; in more than ``DISTANCE`` = 31 of 64 with a chance of about
   1e-5.  Such a pair needs 33 equal minima, so a class of which fewer than 33 are
   held by any other class has no partner and goes no further.  The others get a
   longer b-bit signature, 2 bits of each of ``PLACES`` = 2048 minima, in which a pair at 0.75
   differs in 384 places on average and in more than ``DIFFER`` = 463 with a chance of about 5e-6.
3. *Multi-index join.*  The signature is split into 16 chunks of 4.  At distance 31
   at most, one chunk has at most floor(31 / 16) = 1 error, so two classes within
   the distance share a key (chunk, the place of the error, the other three).  All
   four error places of each chunk are enumerated: 64 keys, no pair missed.
4. *Links.*  In each key, every class is first compared with the least one, then, where a
   key still holds several components, with one that a hash picks, another in each
   key: linear in any group, and a class meets up to 64 others of its group.  Pairs
   within both distances are confirmed on the sets, and components
   are formed after every round.  Then only keys whose classes still lie in different
   components are compared in full, across components, in tiles of bounded size, each
   pair in the first key that it shares.  So a group of many near copies costs few
   pairs, and no link between components is lost.
5. *Components* by hooking and shortcutting on written tables (rounds grow with the
   logarithm of the longest chain); nothing is collected.

Defined cases: null or empty text, or only blanks, has an empty set and is linked
with nothing; a null id takes no part (component null, kept); rows with the same
id and set are copies of each other under one id; an empty table gives an empty
result; other columns are ignored (``without_near_copies`` keeps them).  The id 2**63 - 1 counts as null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm import kernels as K
from lexiflow.llm.common import LAST_ID, Scratch, let_go, partitions, written
from lexiflow.llm.repeats import ID, TH, keyed, shared_values

SHINGLE, HASHES, CHUNKS, DISTANCE = 5, 64, 16, 31
#: places of the b-bit signature (2 bits each), and in how many a linked pair may differ
PLACES, DIFFER = 2048, 463
#: classes of one key that one tile compares with one another
TILE = 2048
#: rounds of stars before the comparison in full
ROUNDS = 2
_RNG = np.random.Generator(np.random.PCG64(23))
_MUL = _RNG.integers(1, 2**63, PLACES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 2**63, PLACES).astype(np.uint64)


def _minima(flat: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Least value of each set (they start at ``at``) under the k-th hash function."""
    h = flat * _MUL[k]
    h ^= h >> np.uint64(32)
    h += _ADD[k]
    h *= _MUL[(k + 1) % PLACES]
    return np.minimum.reduceat(h, at)


def _row_shingles(part, column: int):
    """For each row of a slice its sorted distinct shingle hashes."""
    buf, off = K.utf8(part.column(column))
    low = K.lower(buf)
    with np.errstate(over="ignore"):
        ws, we, first = K.words(low, off)
        wh = K.span_hash(K.prefix_hash(low), ws, we)
        every = K.shingle_hash(wh, SHINGLE)
        for i in range(part.num_rows):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= SHINGLE:
                yield np.unique(every[a: b - SHINGLE + 1])
            elif b > a:
                yield K.mix(K.shingle_hash(wh[a:b], b - a) + np.uint64(b - a))
            else:
                yield wh[:0]


def _signatures(batches):
    """(id, th, text) -> size, two sums of the set, and the 64 minima."""
    schema = pa.schema([(ID, pa.int64()), (TH, pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
                        ("sig", pa.binary())])
    let_go()
    for batch in batches:
        for part in K.slices(batch, "t", 1 << 20):
            sets = list(_row_shingles(part, 2))
            n = np.array([len(x) for x in sets], np.int64)
            flat = np.concatenate(sets)
            some = np.flatnonzero(n)
            at = (np.cumsum(n) - n)[some]
            f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            sig = np.zeros((len(n), HASHES), np.uint64)
            if len(some):
                with np.errstate(over="ignore"):
                    f1[some] = np.add.reduceat(flat, at)
                    f2[some] = np.add.reduceat(K.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
                    for k in range(HASHES):
                        sig[some, k] = _minima(flat, at, k)
            blobs = [sig[i].tobytes() if n[i] else None for i in range(len(n))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(f1.view(np.int64)),
                                              pa.array(f2.view(np.int64)), pa.array(blobs, pa.binary())], schema=schema)


def _sets(batches):
    """(id, text) -> id, its sorted shingle hashes, its b-bit signature."""
    for batch in batches:
        for part in K.slices(batch, "t", 1 << 20):
            sets = list(_row_shingles(part, 1))
            flat = np.concatenate(sets)
            size = np.array([len(x) for x in sets], np.int64)
            at = np.cumsum(size) - size                   # classes have no empty sets
            bits = np.zeros((len(sets), PLACES // 4), np.uint8)
            with np.errstate(over="ignore"):
                for k in range(PLACES):
                    bits[:, k // 4] |= ((_minima(flat, at, k) >> np.uint64(20)) & np.uint64(3)).astype(np.uint8) << np.uint8(2 * (k % 4))
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)).astype(np.int32)), pa.array(flat.view(np.int64))),
                pa.array([x.tobytes() for x in bits], pa.binary())], ["id", "set", "bits"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, HASHES)


def _values(batch):
    """The 64 (place, minimum) values of each class, for the count of holders."""
    sig = _matrix(batch.column(1))
    with np.errstate(over="ignore"):
        h = K.mix(sig + _ADD[:HASHES]).ravel()
    m = len(sig)
    return np.repeat(batch.column(0).to_numpy(), HASHES), np.zeros(m * HASHES, np.int64), np.tile(np.arange(HASHES), m), h


_KEYS = [(c, e) for c in range(CHUNKS) for e in range(HASHES // CHUNKS)]


def _key_matrix(sig: np.ndarray) -> np.ndarray:
    """classes x 64 keys: a chunk without one of its places."""
    size = HASHES // CHUNKS
    out = np.empty((len(sig), len(_KEYS)), np.uint64)
    with np.errstate(over="ignore"):
        for j, (c, e) in enumerate(_KEYS):
            h = np.full(len(sig), K.BASE * np.uint64(j + 1), np.uint64)
            for p in range(size):
                if p != e:
                    h = K.mix(h + sig[:, c * size + p])
            out[:, j] = h
    return out


def _keys(batches):
    for batch in batches:
        if batch.num_rows:
            keys = _key_matrix(_matrix(batch.column(1))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(
                batch.column(0).to_numpy(), len(_KEYS)))], ["key", "id"])


def _bits(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PLACES // 32)


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places two b-bit signatures differ."""
    z = x ^ y
    return np.bitwise_count((z | (z >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(1, dtype=np.int64)


def _close(batches):
    """(a, b, bits a, bits b) -> the pairs within the distance."""
    for batch in batches:
        if batch.num_rows:
            ok = pa.array(_differ(_bits(batch.column(2)), _bits(batch.column(3))) <= DIFFER)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])


def _tiles(batches):
    """Rows (key, tile, id, n, label, sig, bits, block, lo), sorted by key and tile -> close pairs across labels.

    A pair is given only by the first key that it shares.
    """
    def solve(rows):
        key = rows[0].column(0)[0].as_py()
        t = pa.Table.from_batches(rows)
        ids, n, label = (t.column(c).to_numpy() for c in ("id", "n", "label"))
        block, first = t.column("block").to_numpy(), t.column("lo")[0].as_py()
        own = t.column("tile")[0].as_py()
        sig = _matrix(t.column("sig"))
        keys, bits, short = _key_matrix(sig), _bits(t.column("bits")), (sig & np.uint64(0xFFFF)).astype(np.uint16)
        left = np.flatnonzero(block == first)
        # a tile of one block compares the block with itself; else the first block with the second
        right = left if own == first * 1_000_003 + first else np.flatnonzero(block != first)
        for i in left:
            j = right[(label[right] != label[i]) & (4 * n[right] >= 3 * n[i]) & (4 * n[i] >= 3 * n[right])]
            if right is left:
                j = j[ids[j] > ids[i]]
            if not len(j):
                continue
            j = j[(short[j] != short[i]).sum(1) <= DISTANCE]
            j = j[_differ(bits[j], bits[i]) <= DIFFER]
            if not len(j):
                continue
            same = keys[j] == keys[i]
            j = j[keys[i][same.argmax(1)] == np.int64(key).view(np.uint64)]
            if len(j):
                a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    now, got = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        cut = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1, [len(at)]])
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if now is not None and tuple(at[i]) != now:
                yield from solve(got)
                got = []
            now = tuple(at[i])
            got.append(batch.slice(i, j - i))
    if got:
        yield from solve(got)


def components(nodes: DataFrame, edges: DataFrame, written) -> DataFrame:
    """(id, label): the least id that each id reaches over ``edges`` (a, b); tables by ``written(df, name)``, few rounds.

    Each round hooks the parent of a node, and the node itself, to the least grandparent
    among its neighbours, and shortcuts; it ends when no grandparent changes.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    linked = both.select(F.col("a").alias("id")).distinct()
    f = written(linked.select("id", F.col("id").alias("f"), F.col("id").alias("g")), "parents")
    while True:
        near = (both.join(f.select(F.col("id").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("m"))
                .join(f.withColumnRenamed("id", "a"), "a"))
        hooks = (near.select(F.col("f").alias("id"), "m").unionAll(near.select(F.col("a").alias("id"), F.least("m", "g").alias("m")))
                 .groupBy("id").agg(F.min("m").alias("m")))
        step = f.join(hooks, "id", "left").select("id", F.least("f", "m").alias("f"), F.col("g").alias("was"))
        # both tables below read this one, so it is written
        step = written(step, "step")
        new = step.join(step.select(F.col("id").alias("f"), F.col("f").alias("g")), "f").select("id", "f", "g", "was")
        new = written(new, "parents")
        f = new.select("id", "f", "g")
        if new.where("g <> was").limit(1).count() == 0:
            break
    return nodes.join(f.select("id", F.col("g").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) within the distance of b-bit signatures."""
    own = sets.select("id", "bits")
    return (pairs.join(own.toDF("b", "sb"), "b").join(own.toDF("a", "sa"), "a").select("a", "b", "sa", "sb")
            .mapInArrow(_close, "a long, b long"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    a = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(b, "b").join(a, "a").withColumn("x", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("x") >= 75 * (F.size("sa") + F.size("sb") - F.col("x"))).select("a", "b")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ID, TH, n, component): one row per row of ``docs``; the component is null where the set is empty or the id null."""
    spark = docs.sparkSession
    tmp = Scratch(spark)
    rows = keyed(docs, id_col, text_col).select(ID, TH, F.col(text_col).alias("t"))
    sigs = tmp.written(rows.mapInArrow(_signatures, f"{ID} long, {TH} long, n long, f1 long, f2 long, sig binary"), "signatures")
    print_of = ["n", "f1", "f2"]
    named = sigs.where((F.col("n") > 0) & (F.col(ID) < LAST_ID))
    # two classes can have one id (rows with the same id), so a class has a number of its own, made as it is written
    classes = tmp.written(named.groupBy(*print_of).agg(F.min_by(F.struct(ID, TH, "sig"), F.struct(ID, TH)).alias("x")).select(
        F.monotonically_increasing_id().alias("node"), F.col(f"x.{ID}").alias("id"), *print_of,
        F.col(f"x.{TH}").alias("th"), F.col("x.sig").alias("sig")), "classes")
    held = shared_values(classes.select("node", "sig"), _values)
    enough = held.where(F.col("held") >= HASHES - DISTANCE).select("node")
    alive = tmp.written(classes.join(enough, "node").select(F.col("node").alias("id"), "n", "sig", F.col("id").alias("doc"), "th"), "alive")
    wanted = alive.select(F.col("doc").alias(ID), F.col("th").alias(TH), "id").dropDuplicates([ID, TH])
    sets = tmp.written(rows.join(wanted, [ID, TH]).dropDuplicates(["id"]).select("id", "t").mapInArrow(
        _sets, "id long, set array<long>, bits binary"), "sets")
    keys = tmp.written(alive.select("id", "sig").mapInArrow(_keys, "key long, id long"), "keys")
    # stars: every class of a key against its least; then, where a key holds several components, against one
    # that a hash picks, another in every key and round
    links, label = None, alive.select("id", F.col("id").alias("label"))
    for seed in range(ROUNDS):
        k = keys.join(label, "id") if seed else keys.withColumn("label", F.col("id"))
        order = F.xxhash64("id", "key", F.lit(seed)) if seed else F.col("id")
        centre = (k.groupBy("key").agg(F.min(F.struct(order.alias("o"), "id", "label")).alias("c"), F.min("label").alias("lo"),
                                       F.max("label").alias("hi")).where("lo <> hi").select("key", "c"))
        star = (k.join(centre, "key").where("label <> c.label")
                .select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct())
        got = _confirmed(_near(star, sets), sets)
        links = tmp.written(got if links is None else links.unionAll(got), "links")
        label = tmp.written(components(alive.select("id"), links, tmp.written), "labels")
    # keys that still hold several components
    spread = (keys.join(label, "id").groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                                        F.count(F.lit(1)).alias("c")).where("lo <> hi").select("key", "c"))
    m = (keys.join(spread, "key").join(label, "id").join(alive.select("id", "n", "sig"), "id").join(sets.select("id", "bits"), "id")
         .withColumn("blocks", F.ceil(F.col("c") / TILE).cast("int"))
         .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("long"))
         .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other"))
         .withColumn("tile", F.col("lo") * 1_000_003 + F.greatest("block", "other"))
         .select("key", "tile", "id", "n", "label", "sig", "bits", "block", "lo"))
    across = (m.repartition(partitions(spark), "key", "tile").sortWithinPartitions("key", "tile")
              .mapInArrow(_tiles, "a long, b long").distinct())
    more = tmp.written(_confirmed(across, sets), "links")
    label = tmp.written(components(alive.select("id"), links.unionAll(more), tmp.written), "labels")
    # least document of each component, for every class
    of = label.join(alive.select("id", "doc"), "id")
    least = of.groupBy("label").agg(F.min("doc").alias("component"))
    of = label.join(least, "label").select(F.col("id").alias("node"), "component", "label")
    every = classes.join(of, "node", "left").select(*print_of, F.coalesce("component", "id").alias("component"),
                                                    F.coalesce("label", "node").alias("class"))
    got = sigs.drop("sig").join(every, print_of, "left")
    got = written(got.select(ID, TH, "n", F.when(F.col(ID) < LAST_ID, F.col("component")).alias("component"), "class"), "components")
    tmp.drop()
    return got


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    got = _classes(docs, id_col, text_col)
    kind = dict(docs.dtypes)[id_col]
    own = F.when(F.col(ID) < LAST_ID, F.col(ID))
    return got.select(own.cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.coalesce("component", own).cast(kind).alias("component_id"),
                      F.coalesce(F.coalesce("component", own) == own, F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: one of each component, all rows without words or id."""
    got = _classes(docs, id_col, text_col)
    has_id = F.col(ID) < LAST_ID
    best = (got.where(has_id & (F.col("n") > 0) & (F.col(ID) == F.col("component"))).groupBy(ID, "class").agg(F.min(TH).alias(TH))
            .select(ID, TH))       # texts of one id may be in several components
    alone = got.where(~has_id | (F.col("n") == 0)).select(ID, TH).distinct()
    marks = best.withColumn("__lf_one", F.lit(True)).unionAll(alone.withColumn("__lf_one", F.lit(False)))
    rows = keyed(docs, id_col, text_col).join(marks, [ID, TH])
    # rows equal in id and text, of a component's least document, are one; the key of the join is the key of the group
    one = rows.where("__lf_one").dropDuplicates([ID, TH])
    return one.unionAll(rows.where("not __lf_one")).select(*docs.columns)
