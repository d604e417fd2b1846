"""Mixing sources to temperature weights, realised by block permutations.

A source's weight is its share of all tokens to the power of an exponent,
normalised. The exponent is bisected to the smallest at which no source is
repeated more often than a limit, or to the largest at which the weights'
entropy reaches a target. Tokens are then dealt so that the source that is
repeated least is taken once whole, and every other one as often as its weight
asks: whole epochs, and of the last one the leading blocks, in an order of
blocks permuted anew for each epoch, until the source's budget is used up. So
every document is taken at least once.

Documents fall into BLOCKS blocks of their source by id, so a source that holds
a third of all rows is dealt by many tasks; only the one block in which the
budget ends is taken apart: first by ranges of RANGE ids, then, in the one range
in which it ends, by document. No sum needs the rows of a source, or the
sources, in one place.

A null source counts as the empty name, and a null text has no tokens. A source
without tokens is taken once. Every row counts, whether or not others repeat its
id or all of it; a null id is as 0. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, row_key, settle

BLOCKS = 512
STEPS = 60
#: Ids of a range, of which a block holds one in BLOCKS.
RANGE = 1 << 20


def n_words(text: Column) -> Column:
    """Words of a text between blanks; 0 for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("long")


def exponent(most_over_least: Column, repeats: float) -> Column:
    """Bisects the exponent by the largest share over the smallest: the source
    of the smallest is the one that is repeated most."""

    def step(at: Column, _: Column) -> Column:
        middle = (at["low"] + at["high"]) / 2
        good = F.pow(most_over_least, 1 - middle) <= repeats
        return F.when(good, F.struct(at["low"].alias("low"), middle.alias("high"))).otherwise(F.struct(middle.alias("low"), at["high"].alias("high")))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["high"]


def exponent_of_entropy(shares: DataFrame, entropy: float, at_once: int = 3) -> float:
    """Bisects the exponent over a table of positive shares (share) to the largest
    at which the weights' entropy reaches ``entropy``: 0 if none does, 1 if all do.

    A job sums the powers for all the middles that its ``at_once`` steps may ask
    for, so the driver holds some numbers, however many sources there are.
    """
    low, high = 0.0, 1.0
    for _ in range(0, STEPS, at_once):
        parts = 1 << at_once
        tried = [low + (high - low) * k / parts for k in range(1, parts)]
        # the entropy of p^x / z is log z - x * sum(p^x log p) / z; decimals add up alike in any order
        power = lambda x: F.pow("share", F.lit(x))
        sums = [c for x in tried for c in (F.sum(power(x).cast("decimal(30,22)")), F.sum((power(x) * F.log("share")).cast("decimal(30,22)")))]
        got = shares.agg(*[c.cast("double").alias(f"s{k}") for k, c in enumerate(sums)]).first()
        if got is None or got[0] is None:
            return 1.0
        reach = [math.log(got[2 * k]) - x * got[2 * k + 1] / got[2 * k] >= entropy for k, x in enumerate(tried)]
        many = sum(reach)  # entropy falls as the exponent grows, so those that reach it come first
        low, high = low + (high - low) * many / parts, low + (high - low) * (many + 1) / parts
    return high


def source_budgets(tokens: DataFrame, *, repeats: float | None = 2.0, entropy: float | None = None) -> DataFrame:
    """(source, tokens, weight, budget) by ``tokens`` (source, n_tokens); either
    ``repeats`` or ``entropy`` is given."""
    totals = settle(tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    some = totals.filter("tokens > 0")
    whole = some.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("most"), F.min("tokens").alias("least"))
    if entropy is None:
        x = F.round(exponent(F.col("most") / F.col("least"), repeats), 12)
    else:
        total = some.agg(F.sum("tokens")).first()[0]
        x = F.lit(round(exponent_of_entropy(some.select((F.col("tokens") / F.lit(total or 1)).alias("share")), entropy), 12))
    whole = settle(whole.withColumn("x", x))
    powered = some.join(F.broadcast(whole)).agg(F.sum(F.pow(F.col("tokens") / F.col("all"), F.col("x")).cast("decimal(30,22)")).cast("double").alias("sum"))
    joined = totals.join(F.broadcast(whole)).join(F.broadcast(powered))  # one row of sums each
    share = F.col("tokens") / F.col("all")
    return joined.select(
        "source", "tokens",
        F.when(F.col("tokens") > 0, F.round(F.pow(share, F.col("x")) / F.col("sum"), 9)).otherwise(0.0).alias("weight"),
        F.when(F.col("tokens") > 0, F.floor(F.round(F.col("tokens") * F.pow(F.col("most") / F.col("tokens"), 1 - F.col("x")), 3))).otherwise(0).alias("budget"),
    )


def _dealt(docs: DataFrame, repeats: float | None, entropy: float | None) -> DataFrame:
    """row_key, doc_id, source, n_tokens, block, weight, place and epochs of every row."""
    named = F.coalesce("doc_id", row_key(docs))  # rows without an id are dealt like others
    own = settle(
        docs.select(
            row_key(docs).alias("row_key"), "doc_id", F.coalesce("source", F.lit("")).alias("source"), n_words(F.col("text")).alias("n_tokens"),
            F.pmod(named, F.lit(BLOCKS)).cast("int").alias("block"), F.floor(named / RANGE).cast("long").alias("part"),
        )
    )
    budgets = settle(source_budgets(own, repeats=repeats, entropy=entropy))
    blocks = own.groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block"))
    blocks = blocks.join(budgets, "source").withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1)).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    permuted = Window.partitionBy("source").orderBy(F.md5(F.concat_ws("|", "source", "whole", "block").cast("binary")), "block")  # over BLOCKS rows at most
    blocks = blocks.withColumn("until", F.sum("in_block").over(permuted)).withColumn("place", F.row_number().over(permuted)).withColumn("left", F.col("rest") - (F.col("until") - F.col("in_block")))
    # left: what the budget has left where this block begins; the block is taken whole, in part or not
    blocks = settle(blocks.select("source", "block", "weight", "place", "whole", "left", ((F.col("left") >= F.col("in_block")) & (F.col("rest") > 0)).alias("all"), ((F.col("left") > 0) & (F.col("left") < F.col("in_block"))).alias("some")))
    dealt = own.join(blocks, ["source", "block"])
    cut = dealt.filter("some")
    ranges = cut.groupBy("source", "block", "part", "left").agg(F.sum("n_tokens").alias("in_part"))
    before = F.sum("in_part").over(Window.partitionBy("source", "block").orderBy("part")) - F.col("in_part")
    ranges = settle(ranges.select("source", "block", "part", "in_part", (F.col("left") - before).alias("left_here")))
    cut = cut.join(ranges, ["source", "block", "part"])
    inside = Window.partitionBy("source", "block", "part").orderBy("doc_id", "row_key").rowsBetween(Window.unboundedPreceding, 0)
    plain, torn = cut.filter("left_here < 0 or left_here >= in_part"), cut.filter("left_here >= 0 and left_here < in_part")
    columns = ["row_key", "doc_id", "source", "n_tokens", "block", "weight", "place"]

    def told(df: DataFrame, more: Column) -> DataFrame:
        return df.select(*columns, (F.col("whole") + F.when(more, 1).otherwise(0)).cast("int").alias("epochs"))

    every = told(dealt.filter("not some"), F.col("all"))
    every = every.unionByName(told(plain, (F.col("left_here") >= F.col("in_part")) & (F.col("left_here") >= 0)))
    return every.unionByName(told(torn.withColumn("run", F.sum("n_tokens").over(inside)), F.col("run") <= F.col("left_here")))


def mixed(docs: DataFrame, *, repeats: float | None = 2.0, entropy: float | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, block, weight, epochs, place): how often each row
    of ``docs`` is taken, its source's weight, its block, and the place of the
    block in the order of its last epoch."""
    return _dealt(docs, repeats, entropy).drop("row_key").select("doc_id", "source", "n_tokens", "block", "weight", "epochs", "place")


def repeated(docs: DataFrame, *, repeats: float | None = 2.0, entropy: float | None = None) -> DataFrame:
    """``docs`` with each row as often as the mixture takes it."""
    how = _dealt(docs, repeats, entropy).select(F.col("row_key").alias("own_key"), F.col("doc_id").alias("own_id"), "epochs")
    # rows alike in every column are one here, as often as all of them together
    how = settle(how.groupBy("own_key", "own_id").agg(F.sum("epochs").cast("int").alias("epochs")))
    keyed = docs.withColumn("own_key_of_row", row_key(docs))
    alike = Window.partitionBy("own_key_of_row", "doc_id").orderBy("own_key_of_row")
    # as many rows as documents: the same join at every size, never a broadcast
    joined = keyed.join(how.hint("merge"), (F.col("own_key_of_row") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id")))
    one = joined.withColumn("nth_alike", F.row_number().over(alike)).filter("nth_alike = 1")
    return one.withColumn("copy_of_row", F.explode(F.sequence(F.lit(1), F.col("epochs")))).select(*docs.columns)
