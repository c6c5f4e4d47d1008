"""Pairs of rows: all, balanced (round robin) and random, and the geometry profile over them.

Nothing here joins every row with every other: pairs are computed from their numbers, and a
budget of M pairs touches 2M rows at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import positions, shuffled

PAIR_SALT, BANK_SALT = "pair", "perm"


def all_pairs(spark: SparkSession, n: int) -> DataFrame:
    """pair_id, i, j for all i < j below n: row i has n - 1 - i of them."""
    rows = spark.range(n - 1).select(F.col("id").alias("i"))
    return rows.select("i", F.explode(F.sequence(F.col("i") + 1, F.lit(n - 1))).alias("j")).select((F.col("i") * (2 * n - F.col("i") - 1) / 2 + F.col("j") - F.col("i") - 1).cast("long").alias("pair_id"), "i", "j")


def balanced_slots(spark: SparkSession, n: int, target: int) -> DataFrame:
    """seq, left, right: the first ``target`` edges of a round robin over slots 0..n-1.

    In round r of m - 1 (m: n, or n + 1 with a dummy) slot 0 stays and the others turn by one; place q
    meets place m - 1 - q.  Every pair occurs once, and in any prefix the slots' degrees differ by
    two at most."""
    m, half = n + n % 2, (n + n % 2) // 2
    each = half - n % 2  # edges of a round without the dummy's
    rounds = min(m - 1, -(-target // max(1, each)))
    grid = spark.range(rounds * half).select((F.col("id") / half).cast("long").alias("r"), (F.col("id") % half).alias("q"))
    left = F.when(F.col("q") == 0, 0).otherwise(1 + F.pmod(F.col("q") - 1 - F.col("r"), F.lit(m - 1)))
    right = 1 + F.pmod(F.lit(m - 2) - F.col("q") - F.col("r"), F.lit(m - 1))
    edges = grid.select("r", "q", left.alias("left"), right.alias("right"))
    if n % 2:  # the dummy (slot n) is met at one place of each round; the places behind it move up
        dummy = F.when(F.col("r") < half, F.col("r")).otherwise(m - 1 - F.col("r"))
        edges = edges.where(F.greatest("left", "right") < n)
        seq = F.col("r") * each + F.col("q") - (F.col("q") > dummy).cast("int")
    else:
        seq = F.col("r") * half + F.col("q")
    return edges.select(seq.cast("long").alias("seq"), "left", "right").where(F.col("seq") < target)


def balanced_pairs(rows: DataFrame, n: int, target: int, seed: int) -> DataFrame:
    """pair_id, i, j (i < j) over positions of ``rows`` (key, pos): slots are filled in a random order of the keys."""
    key = next(c for c in rows.columns if c != "pos")
    slots = positions(rows.select(key, "pos").withColumn("_h", shuffled(PAIR_SALT, seed, key)), "_h", key, name="slot").select("slot", "pos")
    edges = balanced_slots(rows.sparkSession, n, target)
    at = lambda side: slots.select(F.col("slot").alias(side), F.col("pos").alias(f"p{side}"))
    joined = edges.join(at("left"), "left").join(at("right"), "right")
    return joined.select(F.col("seq").alias("pair_id"), F.least("pleft", "pright").alias("i"), F.greatest("pleft", "pright").alias("j"))


def random_pairs(spark: SparkSession, n: int, target: int, seed: int) -> DataFrame:
    """The first ``target`` different pairs of a stream of draws; a larger target only adds pairs."""
    draws, total = max(64, target * 2), n * (n - 1) // 2
    if target >= total:
        return all_pairs(spark, n)
    draw = lambda side: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(side), F.lit(str(seed)), F.col("id").cast("string"))), 1, 12), 16, 10).cast("long"), F.lit(n))
    while True:
        found = spark.range(draws).select("id", draw("a").alias("a"), draw("b").alias("b")).where("a <> b")
        first = found.groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.min("id").alias("id"))
        if draws >= 64 * total or first.count() >= target:
            break
        draws *= 2
    return positions(first.orderBy("id").limit(target), "id", name="pair_id").select("pair_id", "i", "j")


def sample_pairs(rows: DataFrame, n: int, max_pairs: int, seed: int, kind: str = "balanced") -> DataFrame:
    """All pairs if they fit the budget."""
    if n * (n - 1) // 2 <= max_pairs:
        return all_pairs(rows.sparkSession, n)
    if kind == "balanced":
        return balanced_pairs(rows, n, max_pairs, seed)
    if kind == "random":
        return random_pairs(rows.sparkSession, n, max_pairs, seed)
    raise ValueError(f"no such sampler: {kind}")


def geometry(pairs: DataFrame, scaled: DataFrame, features: Sequence[str]) -> DataFrame:
    """pair_id, i, j and, for each feature, the squared difference of its scaled values."""
    a = scaled.select(F.col("pos").alias("i"), *(F.col(c).alias(f"_a{k}") for k, c in enumerate(features)))
    b = scaled.select(F.col("pos").alias("j"), *(F.col(c).alias(f"_b{k}") for k, c in enumerate(features)))
    joined = pairs.join(a, "i").join(b, "j")
    return joined.select("pair_id", "i", "j", *(((F.col(f"_a{k}") - F.col(f"_b{k}")) * (F.col(f"_a{k}") - F.col(f"_b{k}"))).alias(c) for k, c in enumerate(features)))


def permutation_bank(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """b, pos, src: for each of ``draws`` one random order of all rows, shared by all features.

    One range sort of all draws; a draw's places begin at b * n."""
    key = next(c for c in rows.columns if c != "pos")
    n = rows.count()
    every = rows.select(key, F.col("pos").alias("src")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    numbered = positions(every.withColumn("_h", shuffled_by_draw(seed, key)), "b", "_h", key)
    return numbered.select("b", (F.col("pos") - F.col("b") * F.lit(n)).cast("long").alias("pos"), "src")


def shuffled_by_draw(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(BANK_SALT), F.lit(str(seed)), F.col("b").cast("string"), F.col(key).cast("string")))
