"""Line dedup by overlapping windows of three lines.

Every three lines in a row are hashed to 128 bits; windows that stand anywhere
else too are found over the whole corpus, and each occurrence but the first (by
id, then place) has its three lines removed. Windows overlap: what is removed
is the union of the lines that they cover.

Counts are taken map-side first, and what is joined lies in settled tables, so
a window that stands in a third of all documents is no task's alone. A
document's removed places are gathered per document, never per window.

Lines are what stands between newlines. A text of fewer than three lines has no
window and stays; so does a null text, and a row without an id. Rows that
repeat id and text are one document. A text all of whose lines go is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

LINES = 3


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn("own_text", F.xxhash64("text"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(at_id, at_text, places): the windows of each document that stand before it."""
    lines = F.split("text", "\n", -1)
    at = _marked(docs.filter("doc_id is not null and text is not null").select("doc_id", "text"))
    at = at.select("doc_id", "own_text", lines.alias("lines")).filter(F.size("lines") >= LINES)

    def hashes(k):
        three = [F.get("lines", k + j) for j in range(LINES)]
        return F.struct(F.xxhash64(*three).alias("h"), F.xxhash64(F.lit("second"), *three).alias("g"))

    windows = at.select("doc_id", "own_text", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("lines") - LINES), hashes)).alias("place", "key"))
    windows = settle(windows.select("doc_id", "own_text", "place", "key.h", "key.g"))
    first = F.min(F.struct("doc_id", "own_text", "place")).alias("first")
    twice = settle(windows.groupBy("h", "g").agg(F.count("*").alias("n"), first).filter("n > 1").select("h", "g", "first"))
    later = windows.join(twice, ["h", "g"]).filter(F.struct("doc_id", "own_text", "place") != F.col("first"))
    return later.groupBy(F.col("doc_id").alias("at_id"), F.col("own_text").alias("at_text")).agg(F.collect_set("place").alias("places"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with texts rid of repeated windows, and n_lines and
    n_removed_lines (long, null for a null text)."""
    # the places grow with the documents: the same join at every size, never a broadcast;
    # they come dealt by id and hash of the text already, so only the texts are shuffled to them
    found = repeated_windows(docs)
    joined = _marked(docs.drop("n_lines", "n_removed_lines")).join(found.hint("merge"), (F.col("doc_id") == F.col("at_id")) & (F.col("own_text") == F.col("at_text")), "left")
    lines = F.split("text", "\n", -1)
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.array(*[p + j for j in range(LINES)]))))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    joined = joined.withColumn("n_lines", F.when(F.col("text").isNotNull(), F.size(lines).cast("long")))
    joined = joined.withColumn("n_removed_lines", F.when(F.col("places").isNotNull(), F.size(covered)).when(F.col("text").isNotNull(), 0).cast("long"))
    kept = F.get(F.transform(F.array(lines), lambda all_: F.array_join(F.transform(stay, lambda k: F.get(all_, k)), "\n")), F.lit(0))  # split once a text
    joined = joined.withColumn("text", F.when(F.col("places").isNotNull(), kept).otherwise(F.col("text")))
    return joined.drop("own_text", "at_id", "at_text", "places")
