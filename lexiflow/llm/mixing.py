"""Mix sources to target weights by Sainte-Lague apportionment of equal blocks.

Targets: the sources in code-point order (null last) weigh 5, 2, 1, 5, 2, ...
and share ``share`` times all words by weight.  A source stops at ``most`` times
its size, and what it can't take is shared again by weight.  With sources sorted by
most * size / weight, every prefix that stops leaves a level
(words left / weight left) for the rest; the largest of these levels L settles
all: target = least(most * size, L * weight).

Quotas: blocks of ``block`` words go to sources by highest quotients
target / (2k + 1), and the blocks of a source to its shards by the same rule on
the shards' sizes.  A shard holds about ``shard_words`` words of one source, by a
seeded hash of the id, so no group grows with the input.

Blocks: the documents of a shard, in seeded order, are cut into equal blocks.
A quota of q blocks out of n takes every block q div n times, and q mod n of them
once more: those at evenly spaced places after a seeded offset.  A document takes
the words of its share of these blocks, by a closed formula, so no block is ever
a row.

Defined cases: null or empty text has size 0 and takes 0; a null source is a
source of its own, the last; rows with equal ids are rows of their own; an empty
table gives an empty result; other columns are ignored (``mixed`` keeps them).
Only ids, sources and sizes move; the word count is a native expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import WORD, written

WEIGHTS = (5, 2, 1)


def sainte_lague(parties: DataFrame, group: list[str], order: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """``parties`` with ``out``: the seats of each, by highest quotients votes / (2k + 1) in its group.

    ``seats`` is the number to give out, equal in all rows of a group; ties go by ``order``.  A divisor a
    little too large gives each party all but about one of its seats at once; the rest, no more than there
    are parties, go by rank of the next quotients.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    v, m = F.col(votes).cast("double"), F.col(seats)
    p = (parties.withColumn("__v", F.sum(v).over(w)).withColumn("__n", F.count(F.lit(1)).over(w))
         .withColumn("__low", F.when((F.col("__v") > 0) & (m > F.col("__n") / 2),
                                     F.floor(v * (m - F.col("__n") / 2) / F.col("__v") + 0.5)).otherwise(0).cast("long"))
         .withColumn("__left", m - F.sum("__low").over(w))
         .withColumn("__more", F.when(F.col("__v") > 0, F.ceil(v / F.col("__v") * F.col("__n")) + 2).otherwise(0).cast("int")))
    quotient = (p.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__more"))))
                .withColumn("__q", v / (2 * (F.col("__low") + F.col("__k")) + 1)))
    rank = F.row_number().over(w.orderBy(F.desc("__q"), *order, "__k"))
    won = (F.col("__k") < F.col("__more")) & (F.col("__rank") <= F.col("__left")) & (F.col("__q") > 0)
    own = [c for c in parties.columns]
    return (quotient.withColumn("__rank", rank).groupBy(*own)
            .agg((F.first("__low") + F.sum(won.cast("long"))).alias(out)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) -> with target; one row per source."""
    every = Window.partitionBy(F.lit(0))
    ws = F.array(*[F.lit(float(x)) for x in weights])
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    before = every.orderBy("__ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * most
    got = (sizes.withColumn("__w", F.get(ws, (F.row_number().over(by_name) - 1) % len(weights)))
           .withColumn("__ratio", cap / F.col("__w"))
           .withColumn("__level", (F.sum("source_size").over(every) * share - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
                       / (F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))))
           .withColumn("__level", F.max("__level").over(every)))
    return got.select("source", "source_size", F.least(cap, F.col("__level") * F.col("__w")).cast("double").alias("target"))


def _upto(place: Column, block: int) -> Column:
    """Words before ``place`` (a word's place in the shard) in the blocks that are taken once more."""
    b = F.floor(place / block)
    chosen = lambda x: F.floor((x * F.col("__r") + F.col("__u")) / F.col("__n"))
    return chosen(b) * block + (chosen(b + 1) - chosen(b)) * (place - b * block)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: float = 3.0, block: int = 32,
          shard_words: int = 2_000_000, seed: int = 17, keep: bool = True) -> DataFrame:
    """The rows of ``docs`` (all columns if ``keep``, else the id) with __lf_size, __lf_source_size, __lf_target, __lf_taken."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    kept = docs.columns if keep else [id_col]
    base = written(docs.select(*kept, F.monotonically_increasing_id().alias("__lf_uid"), size.alias("__lf_size"),
                               F.col(id_col).alias("__lf_id"), F.col(source_col).alias("__lf_source"),
                               F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("__lf_mark")), "mix")
    d = base.select(F.col("__lf_uid").alias("uid"), F.col("__lf_id").alias("id"), F.col("__lf_source").alias("source"),
                    F.col("__lf_size").alias("size"), F.col("__lf_mark").alias("mark"))
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    every = Window.partitionBy(F.lit(0))
    targets = targets.withColumn("__m", F.round(F.sum("target").over(every) / block).cast("long"))
    quotas = sainte_lague(targets, [], [F.col("source").asc_nulls_last()], "target", "__m", "blocks").drop("__m")
    quotas = written(quotas, "quotas")           # one row per source
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    d = (d.join(quotas.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
         .withColumn("shard", F.pmod("mark", shards)))       # ids may be null or repeat: the text tells rows apart
    of_shard = d.groupBy("source", "shard", "blocks").agg(F.sum("size").alias("words"))
    got = sainte_lague(of_shard, ["source"], ["shard"], "words", "blocks", "q")
    got = (got.withColumn("__n", F.ceil(F.col("words") / block)).where("__n > 0")
           .withColumn("__q", F.least(F.col("q"), (F.col("__n") * most).cast("long")))
           .withColumn("__full", F.floor(F.col("__q") / F.col("__n"))).withColumn("__r", F.col("__q") % F.col("__n"))
           .withColumn("__u", F.pmod(F.xxhash64("source", "shard", F.lit(seed + 1)), F.col("__n")))
           .select(F.col("source").alias("s"), F.col("shard").alias("h"), "__n", "__full", "__r", "__u"))
    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64("mark", F.lit(seed + 2)), "id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = d.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0)))
    taken = (placed.join(got, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")), "left")
             .withColumn("taken", F.coalesce(F.col("__full") * F.col("size") + _upto(F.col("start") + F.col("size"), block)
                                             - _upto(F.col("start"), block), F.lit(0)).cast("long"))
             .select(F.col("uid").alias("__lf_uid"), F.col("source_size").alias("__lf_source_size"),
                     F.col("target").alias("__lf_target"), F.col("taken").alias("__lf_taken")))
    return base.drop("__lf_id", "__lf_source", "__lf_mark").join(taken, "__lf_uid").drop("__lf_uid")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    got = mixed(docs, id_col, keep=False, **settings)
    return got.toDF("doc_id", "size", "source_size", "target", "taken")
