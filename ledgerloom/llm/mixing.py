"""Mixing sources to target weights by Sainte-Lague apportionment (operator 12).

A source's target is its weight's share of all words, at most `most` times the
source's own, the excess shared anew by weight. The words to take are dealt in
blocks of equal length, a block at a time, to the source with the highest
quotient target / (2 * blocks so far + 1); then each source's blocks to its
shards by the shards' words, in the same way down a tree of at most FAN
children, so no task ever sees more than one node's children. Nothing is dealt
one by one: with S seats, n parties and V votes, the seats by the divisors
V / (S - n) and V / (S + n) enclose the result, and only the few seats between
are compared.

A shard's documents stand in the order of a seeded hash. Its blocks are taken in
whole passes, and the rest from a seeded block on, around the end; so a document's
share follows from where it stands, and a shard gives its quota to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, release

WEIGHTS, MOST, BLOCK, SEED = (5, 2, 1), 3, 16, 42
#: Documents of a shard at about, bits of a shard number that one level of the tree settles, digits of a hash that a number is made from.
PER_SHARD, LEVEL_BITS, DIGITS = 1000, 8, 8
WORD = r"[^\x20\x09-\x0D]+"
SOURCE = ["unnamed", "name"]


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source as (unnamed, name), size and a seeded place: null sources are unnamed, null texts have no words."""
    return docs.select(
        "doc_id",
        F.col("source").isNull().alias("unnamed"),
        F.coalesce("source", F.lit("")).alias("name"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256).alias("place"),
    )


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """`df` as a written table with `rank` from 0 on in a total order, without a single task that holds all rows.

    Sorted partitions are written with their rows' positions; how many rows each
    holds (one number per partition) tells where the next begins.
    """
    at = F.monotonically_increasing_id()
    rows = materialize(df.orderBy(*order).withColumn("__at", at), "ordered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    begins, n = [], 0
    for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        begins.append((r.p, n))
        n += r.n
    table = rows.sparkSession.createDataFrame(begins, "p long, begins long")
    return rows.join(F.broadcast(table), part == F.col("p")).withColumn("rank", F.col("begins") + place).drop("p", "begins", "__at")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Sources (unnamed, name, source_size) with rank, weight and target, in order of code points, unnamed last.

    Weights repeat along the order. A target above `most` times its source is cut
    there and the excess reshared by weight, until none is above.
    """
    ranked = in_order(sources, F.col("unnamed"), F.col("name"))
    kinds = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = ranked.withColumn("weight", kinds[(F.col("rank") % len(weights)).cast("int")]).withColumn("most", most * F.col("source_size"))
    wide = lambda c: c.cast("decimal(18,0)")
    rest, shares = (r := ranked.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()).t or 0, r.w or 1
    total = rest
    while True:
        # Once above its bound a source stays so: what the others share a weight only grows.
        above = wide(F.col("weight")) * wide(F.lit(rest)) > wide(F.col("most")) * wide(F.lit(shares))
        r = ranked.agg(F.sum(F.when(above, F.col("most")).otherwise(0)).alias("m"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("w")).first()
        now = total - (r.m or 0), r.w or 1
        if now == (rest, shares):
            break
        rest, shares = now
    share = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(shares))
    return ranked.withColumn("target", F.when(above, F.col("most").cast("double")).otherwise(share)).drop("weight", "most")


def _enclosed(parties: DataFrame, votes: Column, seats: Column, n: Column, total: Column) -> DataFrame:
    """Adds sure, seats that a party has for certain, and perhaps, the number up to which it may have more."""
    v, s = votes.cast("double"), seats.cast("double")
    safe = F.when(total > 0, total).otherwise(1)
    sure = F.when(seats > n, F.floor(v * (s - n) / safe + 0.5) - 1).otherwise(0)
    perhaps = F.when((votes > 0) & (seats > 0), F.floor(v * (s + n) / safe + 0.5) + 1).otherwise(0)
    return parties.withColumn("sure", F.greatest(sure, F.lit(0)).cast("long")).withColumn("perhaps", perhaps.cast("long"))


def _open_seats(parties: DataFrame, key: list[str], votes: str) -> DataFrame:
    """A row for each seat that is not sure, with its quotient."""
    seats = parties.where("perhaps > sure").select(*key, F.col(votes).alias("v"), F.explode(F.sequence(F.col("sure"), F.col("perhaps") - 1)).alias("k"))
    return seats.select(*key, (F.col("v").cast("double") / (2 * F.col("k") + 1)).alias("quotient"), "k")


def source_quotas(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Sources with quota, the blocks that Sainte-Lague deals to their targets; equal quotients go to the first source."""
    got = sources.agg(F.sum("target").alias("t"), F.sum("source_size").alias("s"), F.count("*").alias("n")).first()
    seats = int(((got.s or 0) + block // 2) // block)
    parties = _enclosed(sources, F.col("target"), F.lit(seats), F.lit(got.n), F.lit(got.t or 0.0))
    left = seats - (parties.agg(F.sum("sure").alias("s")).first().s or 0)
    won = in_order(_open_seats(parties, ["rank"], "target").withColumnRenamed("rank", "r"), F.desc("quotient"), F.col("r"), F.col("k")).where(F.col("rank") < left)
    more = won.groupBy("r").agg(F.count("*").alias("more"))
    return parties.join(more, F.col("rank") == F.col("r"), "left").withColumn("quota", F.col("sure") + F.coalesce("more", F.lit(0))).drop("sure", "perhaps", "r", "more")


def child_quotas(children: DataFrame, parents: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Parents' quotas dealt to their children by words; children of a parent are few. Equal quotients go to the smaller child."""
    own = W.partitionBy(*parent)
    parties = children.join(parents.select(*parent, F.col("quota").alias("__seats")), parent).withColumn("__n", F.count("*").over(own)).withColumn("__v", F.sum("words").over(own))
    parties = _enclosed(parties, F.col("words"), F.col("__seats"), F.col("__n"), F.col("__v"))
    left = F.col("__seats") - F.sum("sure").over(own)
    seats = parties.withColumn("__left", left).where("__left > 0")
    open_ = _open_seats(seats, [*parent, child, "__left"], "words").withColumn("no", F.row_number().over(own.orderBy(F.desc("quotient"), child, "k")))
    more = open_.where("no <= __left").groupBy(*parent, child).agg(F.count("*").alias("more"))
    return parties.join(more, [*parent, child], "left").select(*parent, child, "words", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("quota"))


def shard_quotas(shards: DataFrame, sources: DataFrame, bits: int) -> DataFrame:
    """Sources' quotas dealt down the tree to shards (unnamed, name, shard, words)."""
    quotas = sources.select(*SOURCE, F.lit(0).cast("long").alias("top"), "quota")
    done = 0
    while True:
        # A node's parent is its number without the bits of this level.
        now = min(bits, done + LEVEL_BITS)
        node = F.shiftright("shard", bits - now).cast("long")
        children = shards.groupBy(*SOURCE, F.shiftright("shard", bits - done).cast("long").alias("top"), node.alias("node")).agg(F.sum("words").alias("words"))
        dealt = child_quotas(children, quotas, [*SOURCE, "top"], "node")
        if now == bits:
            return dealt.select(*SOURCE, F.col("node").alias("shard"), "words", "quota")
        quotas, done = dealt.select(*SOURCE, F.col("node").alias("top"), "quota"), now


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED, per_shard: int = PER_SHARD) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies.

    taken is how many of its words the mix takes, repeats counted (at most `most`
    times size); copies how often it is taken whole. A source's taken words differ
    from its target by rounding to blocks, and where it is taken `most` times by
    part of a block a shard. Null texts and texts without words take nothing; a
    null source is a source, the last; repeated rows count each. The same rows
    give the same mix, whatever their order. An empty table gives no rows; other
    columns are ignored.
    """
    rows = materialize(sized(docs, seed), "sized")
    bits = max(0, (rows.count() // per_shard)).bit_length()
    rows_in = rows.withColumn("shard", F.shiftright(_number(F.col("place")), 4 * DIGITS - bits))
    shards = materialize(rows_in.groupBy(*SOURCE, "shard").agg(F.sum("size").alias("words")), "shards")
    sources = materialize(source_quotas(targets(shards.groupBy(*SOURCE).agg(F.sum("words").alias("source_size")), weights, most), block), "sources")
    quotas = shard_quotas(shards, sources, bits).join(sources.select(*SOURCE, "source_size", "target"), SOURCE).withColumnRenamed("words", "total")
    some, due = F.col("total") > 0, F.col("quota") * block
    passes = F.when(some, F.least(F.expr(f"(quota * {block}) div greatest(total, 1)"), F.lit(most))).otherwise(0).cast("long")
    start = _number(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("shard").cast("string"), F.lit(":"), F.col("name")), 256))
    quotas = quotas.withColumn("passes", passes).withColumn("rest", F.when(some & (F.col("passes") < most), due - F.col("passes") * F.col("total")).otherwise(0))
    quotas = materialize(quotas.withColumn("first", block * (start % F.greatest(F.expr(f"total div {block}"), F.lit(1)))), "quotas")
    release(shards, sources)
    end = F.sum("size").over(W.partitionBy(*SOURCE, "shard").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = rows_in.withColumn("b", end).withColumn("a", F.col("b") - F.col("size")).join(quotas.drop("quota"), [*SOURCE, "shard"])
    within = lambda lo, hi: F.greatest(F.lit(0), F.least("b", hi) - F.greatest("a", lo))
    stop = F.col("first") + F.col("rest")
    part = within(F.col("first"), F.least(stop, "total")) + within(F.lit(0).cast("long"), stop - F.col("total"))
    return placed.select(
        "doc_id",
        F.when(~F.col("unnamed"), F.col("name")).alias("source"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("passes") + part).alias("taken"),
        (F.col("passes") + F.when((part == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)).alias("copies"),
    )
