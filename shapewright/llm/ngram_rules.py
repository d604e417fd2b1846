"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams.

Words and pairs of words of every document fall into BUCKETS buckets by hash.
Two multinomials over the buckets are counted: one over the trusted target (the
documents that a label marks as good, all of them), one over the whole raw
corpus. A document's ratio is the sum of log p_target - log p_raw over its n-grams by
their number; it is kept where this reaches a fixed threshold and the base
rules hold. Every document is judged alike, without chance.

Only the BUCKETS log ratios are held by the driver and the tasks. All work is
done by built-in functions. Labels are joined by shuffling each document's
buckets; counts are taken map-side before theirs.

A null text has no words and fails the base rules, as an empty one does. Rows
that repeat an id have a verdict each. A null id is never trusted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.steps import held
from ..functions.text import let
from .common import BLANKS

BUCKETS = 8192
#: Ratio a gram below which a document is dropped: a little under 0, so that a
#: document goes where its grams are clearly likelier in the raw corpus than in the
#: trusted target, and noise about even odds drops none. It is the caller's to set.
THRESHOLD = -0.08
WINDOW = 8
FEWEST_WORDS = 20
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    spaced = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r]", " "), " ")
    return F.filter(spaced, lambda w: w != "")


def paired(hashes: Column, gap: int) -> Column:
    """Hash of each element with the one ``gap`` places on, where there is one."""
    # bound once: inside a lambda the array would be computed anew for each element
    whole = let(hashes, lambda all_: F.transform(all_, lambda h, i: F.xxhash64(h, F.get(all_, i + gap))))
    return F.slice(whole, 1, F.greatest(F.size(hashes) - gap, F.lit(0)))


def bucket(value: Column) -> Column:
    return value.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (long), base_failed, and hashes and pair_hashes, those of the words and of
    each two words in a row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("words", words_of(F.col("text")))
    out = out.withColumns({"hashes": F.transform("words", lambda w: F.xxhash64(w)), "joined": F.array_join("words", ""), "own_lines": F.filter(F.split(text, "\n", -1), lambda v: v.rlike(r"[^ \t-\r]"))})
    out = out.withColumns(
        {
            "n_words": F.size("hashes").cast("long"),
            "word_chars": F.length("joined").cast("long"),
            "n_symbols": F.regexp_count("joined", F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_dup_lines": (F.size("own_lines") - F.size(F.array_distinct("own_lines"))).cast("long"),
            "pair_hashes": paired(F.col("hashes"), 1),
        }
    ).drop("words", "joined", "own_lines")
    # windows of eight words: hashes of two, of four and of eight
    out = out.withColumn("fours", paired(F.col("pair_hashes"), 2)).withColumn("windows", paired(F.col("fours"), 4)).drop("fours")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    # most texts repeat no window, which a set of the hashes tells; only the others are sorted
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    out = out.withColumn("pairs", F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))

    def twice(pairs: Column) -> Column:
        return F.filter(pairs, lambda p, k: F.get(pairs, k + 1)["h"].eqNullSafe(p["h"]) | F.get(pairs, k - 1)["h"].eqNullSafe(p["h"]))

    out = out.withColumn("twice", F.array_sort(F.transform(let(F.col("pairs"), twice), lambda p: p["i"])))
    covered = F.aggregate(F.col("twice"), F.struct(F.lit(0).alias("until"), F.lit(0).alias("n")), lambda a, i: F.struct((i + WINDOW).alias("until"), (a["n"] + i + WINDOW - F.greatest(a["until"], i)).alias("n")))["n"]
    out = out.withColumn("n_repeat_words", covered.cast("long"))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("windows", "pairs", "twice")


def log_ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log p_target - log p_raw of each bucket; counts are smoothed by one."""
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    good = good.select(F.col("doc_id").alias("good_id"))
    hashes = docs.select("doc_id", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    # buckets as small integers: less than the text to shuffle
    own = hashes.select("doc_id", F.transform(F.concat("hashes", paired(F.col("hashes"), 1)), lambda h: bucket(h).cast("short")).alias("buckets"))
    own = own.withColumn("buckets", held(F.col("buckets")))  # no filter on them is moved to before they are made
    told = own.join(good.hint("merge"), F.col("doc_id") == F.col("good_id"), "left")  # never a broadcast: the labels grow with the documents
    grams = told.select(F.col("good_id").isNotNull().cast("int").alias("good"), F.explode("buckets").alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target")).collect()
    raw, target = [1] * BUCKETS, [1] * BUCKETS
    for row in counts:
        raw[row.bucket] += row.raw
        target[row.bucket] += row.target
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for t, r in zip(target, raw, strict=True)]


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base counts, base_failed, log_ratio (null without words)
    and kept; clashing columns are replaced."""
    ratios = F.split(F.lit(",".join(map(repr, log_ratios(docs, labels)))), ",").cast("array<double>")  # the optimiser makes a constant of it
    taken = ["words", "hashes", "joined", "own_lines", "pair_hashes", "fours", "windows", "pairs", "twice", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ratio", "kept"]
    out = base_counts(docs.drop(*taken))

    def total(c: str) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, h: a + F.get(ratios, bucket(h)))

    n = F.size("hashes") + F.size("pair_hashes")
    out = out.withColumn("log_ratio", F.when(n > 0, F.round((total("hashes") + total("pair_hashes")) / n, 9)))
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_ratio") >= threshold, F.lit(False))
    return out.withColumn("kept", kept).drop("hashes", "pair_hashes")
