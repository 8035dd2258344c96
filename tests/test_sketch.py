"""Q12: the sketch of deduplicated characters against the exact aggregation."""

from pyspark.sql import functions as F

from lexiflow.operators.estimate import unique_chars
from lexiflow.plans.folder import estimate_folder


def strings(spark, n, times):
    """``n`` different strings of 1 to 40 characters, each ``times`` times and one of them in a third of all rows."""
    one = spark.range(n).select((F.col("id") % 7).alias("scope"), F.concat(F.expr("repeat('語', int(1 + id % 40))"), "id").alias("text"))
    many = one.crossJoin(spark.range(times).select(F.lit(0).alias("x"))).drop("x")
    return many.unionByName(spark.range(n * times // 2).select(F.lit(3).cast("long").alias("scope"), F.lit("日本").alias("text"))).unionByName(
        spark.range(50).select(F.lit(1).cast("long").alias("scope"), F.lit("plain").alias("text")))


def test_exact_while_the_sketch_is_not_full(spark):
    df = strings(spark, 900, 3)
    exact = unique_chars(df, ["scope"], None).first()
    assert exact.unique_strings == 901 and exact.error == 0.0
    for parts in (1, 9):
        assert unique_chars(df.repartition(parts), ["scope"], 1000).first() == exact
    assert tuple(unique_chars(df.limit(0), ["scope"]).first()) == (0, 0, 0.0)


def test_full_sketches_stay_within_their_bound_and_merge(spark):
    df = strings(spark, 40_000, 2)
    exact = unique_chars(df, ["scope"], None).first()
    for size in (500, 4000):
        got = [unique_chars(df.repartition(p), ["scope"], size).first() for p in (1, 3, 16)]
        assert len({tuple(g) for g in got}) == 1                  # however the rows are dealt
        g = got[0]
        assert 0 < g.error < 2 / size**0.5
        assert abs(g.unique_chars / exact.unique_chars - 1) < 4 * g.error
        assert abs(g.unique_strings / exact.unique_strings - 1) < 4 / (size - 2)**0.5


def test_folder_estimate_counts_a_string_once_in_a_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("日本\n日本\n語\nplain\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("日本\n", encoding="utf-8")
    e = estimate_folder(spark, str(tmp_path))
    assert e.totals.first().total_chars == 7 and tuple(e.unique.first()) == (3, 5, 0.0)
