"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

DataFrame functions only.  Documents of a source are dealt to shards by a seeded hash, laid end to end in a
seeded order and cut into blocks of ``block`` words.  Every source gets as many blocks of the mix as the
Sainte-Lague method (highest quotients target / (2k + 1)) gives it, every shard of the source gets its share of
them by the same method, and a seeded, evenly spread selection picks which blocks of the shard are taken, some of
them more than once.  A document's ``taken`` is what the picked blocks hold of it; blocks are never turned into rows,
the prefix count of picked blocks has a closed form.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; a source without words has
target 0; repeated rows count as often as they occur; an empty table gives an empty table.  No document is taken more
than ``cap`` times its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklane.llm.shared import Scratch, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: Words in a block.
BLOCK = 8
#: Documents that a shard of a source holds, about.
SHARD_ROWS = 20_000


def _webster(df: DataFrame, key: list[str], share: str, seats: str, most: str, tie: list[str]) -> DataFrame:
    """Sainte-Lague seats for the rows of each ``key``: column ``quota``.

    share: non-negative number that seats are in proportion to; seats: how many there are in all; most: the most a row
    can take.  Rounding share * seats / total gives every quotient share / (k + 1/2) above the natural divisor; the few
    seats that are then missing (or too many) go to the next highest quotients (or are taken from the lowest).  A row
    can win (missing + rows) * share / total + 1 of them at most, so as many are listed.  Ties go by ``tie``.
    """
    every = W.partitionBy(*key) if key else W.partitionBy(F.lit(0))
    total = F.sum(share).over(every)
    df = df.withColumn("_exact", F.when(total > 0, F.col(share) * F.col(seats) / total).otherwise(F.lit(0.0)))
    df = df.withColumn("_base", F.least(F.floor(F.col("_exact") + 0.5).cast("long"), F.col(most)))
    open_share = F.sum(F.when(F.col("_base") < F.col(most), F.col(share)).otherwise(F.lit(0.0))).over(every)
    df = df.withColumn("_off", F.col(seats) - F.sum("_base").over(every))
    spread = F.when(F.col("_off") > 0, open_share).otherwise(total)
    listed = F.when(spread > 0, F.floor((F.abs("_off") + F.count(F.lit(1)).over(every)) * F.col(share) / spread) + 2).otherwise(F.lit(2))
    df = df.withColumn("_listed", listed.cast("long"))
    rows = [c for c in df.columns if c not in ("_exact", "_listed")]
    step = df.withColumn("_j", F.explode(F.when(F.col("_off") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_listed")))))
    rise = F.when((F.col("_off") > 0) & (F.col("_base") + F.col("_j") < F.col(most)) & (F.col(share) > 0), (F.col("_base") + F.col("_j") + 0.5) / F.col(share))
    fall = F.when((F.col("_off") < 0) & (F.col("_base") - F.col("_j") > 0) & (F.col(share) > 0), (F.col("_j") + 0.5 - F.col("_base")) / F.col(share))
    step = step.withColumn("_sign", F.round(F.coalesce(rise, fall), 12))  # equal quotients are equal whatever their last bit
    # of equal quotients the first by tie is given a seat first and loses one last
    ties = [k for t in tie for k in (F.when(F.col("_off") > 0, F.col(t)).asc_nulls_last(), F.when(F.col("_off") < 0, F.col(t)).desc_nulls_first())]
    step = step.withColumn("_place", F.row_number().over(every.orderBy(F.col("_sign").asc_nulls_last(), *ties, "_j")))
    step = step.withColumn("_won", (F.col("_sign").isNotNull() & (F.col("_place") <= F.abs("_off"))).cast("long"))
    out = step.groupBy(*rows).agg(F.sum("_won").alias("_won"))
    return out.withColumn("quota", F.col("_base") + F.signum("_off").cast("long") * F.col("_won")).drop("_base", "_off", "_won")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source (columns source, source_size): its target words.

    Sources by code point, null last, weigh ``weights`` in turn and share all words; a source stops at ``cap`` times its
    size and the excess goes to the others by weight.  That ends at one water level: target = min(cap * size, level *
    weight).  One row per source is all that a window here sees.
    """
    everything = W.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("_rank", F.row_number().over(order)).withColumn("_weight", weight)
    df = df.withColumn("_cap", F.col("source_size") * cap).withColumn("_fill", F.col("_cap") / F.col("_weight"))
    before = everything.orderBy("_fill", "_rank").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    df = df.withColumn("_left", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double"))
    df = df.withColumn("_open", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    # the first source, in the order of filling, that the level of all the rest does not fill
    df = df.withColumn("_level", F.when(F.col("_fill") > F.col("_left") / F.col("_open"), F.struct(F.col("_fill"), F.col("_rank"), F.col("_left"), F.col("_open"))))
    df = df.withColumn("_level", F.min("_level").over(everything))
    share = F.col("_level._left") * F.col("_weight") / F.col("_level._open")
    capped = F.col("_level").isNull() | (F.struct("_fill", "_rank") < F.struct(F.col("_level._fill"), F.col("_level._rank")))
    df = df.withColumn("target", F.when(capped, F.col("_cap").cast("double")).otherwise(share))
    return df.drop("_rank", "_weight", "_cap", "_fill", "_left", "_open", "_level")


def _div(number: Column, by: Column) -> Column:
    """Whole-number division of non-negative longs."""
    return ((number - F.pmod(number, by)) / by).cast("long")


def _before(at: Column, block: int) -> Column:
    """Words taken of the first ``at`` words of a shard.

    Block n is picked floor(((n + 1) * quota + phase) / blocks) - floor((n * quota + phase) / blocks) times.
    """
    picks = lambda n: _div(n * F.col("_quota") + F.col("_phase"), F.col("_blocks"))
    whole = _div(at, F.lit(block))
    return picks(whole) * block + (at - whole * block) * (picks(whole + 1) - picks(whole))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: str = SEED,
    block: int = BLOCK,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, source of every row of docs (doc_id, text, source).

    Texts are read once; what moves afterwards is an id, a source and a number per document.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sized = scratch.cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))
    return mix_sized(sized, scratch, weights, cap, seed, block, shard_rows)


def mix_sized(sized: DataFrame, scratch: Scratch, weights=WEIGHTS, cap=CAP, seed=SEED, block=BLOCK, shard_rows=SHARD_ROWS) -> DataFrame:
    """The same for (doc_id, source, size)."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    plan = targets(by_source, weights, cap)
    everything = W.partitionBy(F.lit(0))
    plan = plan.withColumn("_all", F.ceil(F.sum("target").over(everything) / block).cast("long"))
    plan = plan.withColumn("_most", F.floor(F.col("source_size") * cap / block).cast("long"))
    plan = plan.withColumn("_most", F.when(F.col("source_size") > 0, F.greatest(F.col("_most"), F.lit(1))).otherwise(F.lit(0)).cast("long"))
    plan = _webster(plan, [], "target", "_all", "_most", ["source"]).withColumnRenamed("quota", "_source_quota").drop("_all", "_most")
    plan = plan.withColumn("_shards", F.ceil(F.col("_docs") / shard_rows).cast("long"))
    plan = scratch.cut(plan.select("source", "source_size", "target", "_source_quota", "_shards").coalesce(1))

    same = sized["source"].eqNullSafe(plan["source"])
    dealt = sized.join(plan, same, "left").select(sized["doc_id"], sized["source"], "size", "source_size", "target", "_source_quota", "_shards")
    dealt = dealt.withColumn("_draw", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")))
    dealt = dealt.withColumn("_shard", F.pmod(F.conv(F.substring("_draw", 1, 8), 16, 10).cast("long"), F.col("_shards")))

    shards = dealt.groupBy("source", "_shard").agg(F.sum("size").alias("_words"), F.first("_source_quota").alias("_seats"))
    shards = shards.withColumn("_blocks", F.ceil(F.col("_words") / block).cast("long"))
    shards = shards.withColumn("_most", F.col("_blocks") * cap).withColumn("_share", F.col("_words").cast("double"))
    shards = _webster(shards, ["source"], "_share", "_seats", "_most", ["_shard"])
    shards = shards.withColumn("_phase", F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("source"), F.col("_shard").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.greatest(F.col("_blocks"), F.lit(1))))
    shards = scratch.cut(shards.select(F.col("source").alias("_s"), F.col("_shard").alias("_n"), F.greatest(F.col("_blocks"), F.lit(1)).alias("_blocks"), F.col("quota").alias("_quota"), "_phase"))

    line = W.partitionBy("source", "_shard").orderBy("_draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    laid = dealt.withColumn("_end", F.sum("size").over(line)).withColumn("_start", F.col("_end") - F.col("size"))
    laid = laid.join(shards, laid["source"].eqNullSafe(shards["_s"]) & (laid["_shard"] == shards["_n"]), "left")
    taken = (_before(F.col("_end"), block) - _before(F.col("_start"), block)).cast("long")
    return laid.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
