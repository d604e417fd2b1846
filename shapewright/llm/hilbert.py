"""Sharding along a Hilbert curve through several metadata dimensions.

Each dimension is quantised to a few bits, which gives a bounded number of
cells; the cells are numbered along the curve, and the rows, in the order of
cell, hash of the id and id, are cut into shards whose counts are at most one
apart. A shard then covers a compact region in all dimensions, so that ranges
kept for each file prune on any of them.

No task sees all rows: a row's rank is the rows in cells before its own, those
in groups before its own in the cell (groups by the leading bits of the hash),
and those before it in its group. A cell that holds a third of all rows falls
into ``GROUPS`` groups.

Sizes: a null text has size 1 and crc32 0. Null ids come first in their cell;
rows that repeat an id are ranked by size and crc32, and equal rows in any
order, which no column tells apart. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

GROUP_BITS = 10


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _curve_index(axes: Column, count: int, bits: int) -> Column:
    """The place on the curve of a cell (array of ``count`` ints of ``bits`` bits).

    The cell is turned and mirrored level by level into the transposed index,
    by array functions alone; then the Gray code is undone and bits interleaved.
    """
    steps = F.array(*[F.struct(F.lit(1 << level).alias("q"), F.lit(axis).alias("i")) for level in range(bits - 1, 0, -1) for axis in range(count)])

    def turn(at: Column, step: Column) -> Column:
        low, here = step["q"] - 1, F.get(at, step["i"])
        inverted = here.bitwiseAND(step["q"]) != 0
        swapped = F.when(inverted, 0).otherwise(F.get(at, F.lit(0)).bitwiseXOR(here).bitwiseAND(low))
        changes = F.struct(F.when(inverted, low).otherwise(swapped).alias("first"), swapped.alias("other"))
        return _let(changes, lambda c: F.transform(at, lambda v, k: F.when(k == 0, v.bitwiseXOR(c["first"])).when(k == step["i"], v.bitwiseXOR(c["other"])).otherwise(v)))

    # where the axis is the first one, swapping it with itself changes nothing, as the rule gives
    levels = F.array(*[F.lit(1 << level) for level in range(bits - 1, 0, -1)])
    places = F.array(*[F.struct(F.lit(axis).alias("i"), F.lit(1 << level).alias("q")) for level in range(bits - 1, -1, -1) for axis in range(count)])

    def grays(turned: Column) -> Column:
        return F.transform(turned, lambda _, k: F.aggregate(F.slice(turned, 1, k + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))

    def fixed(gray: Column) -> Column:
        last = F.element_at(gray, -1)
        return _let(F.aggregate(levels, F.lit(0), lambda a, q: F.when(last.bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a)), lambda fix: F.transform(gray, lambda v: v.bitwiseXOR(fix)))

    def interleaved(final: Column) -> Column:
        return F.aggregate(places, F.lit(0).cast("long"), lambda a, p: a * 2 + F.when(F.get(final, p["i"]).bitwiseAND(p["q"]) != 0, 1).otherwise(0))

    return _let(_let(_let(F.aggregate(steps, axes, turn), grays), fixed), interleaved)


def hilbert_rank(rows: DataFrame, dimensions: Sequence[Column], bits: int, key: Sequence[str]) -> DataFrame:
    """``rows`` with curve_index, rank (from 0, gapless) and n_rows.

    ``dimensions`` are ints of ``bits`` bits; at most 16 bits in all, so that
    there are at most 65,536 cells. ``key`` orders the rows of a cell.
    """
    if bits * len(dimensions) > 16:
        raise ValueError("over 16 bits in all")
    axes = F.array(*[d.cast("int") for d in dimensions])
    mixed = F.xxhash64(*key)
    placed = rows.withColumn("axes", axes).withColumn("mixed", mixed).withColumn("part", F.shiftrightunsigned("mixed", 64 - GROUP_BITS).cast("int"))
    sizes = settle(placed.groupBy("axes", "part").agg(F.count("*").alias("n")))
    cells = sizes.groupBy("axes").agg(F.sum("n").alias("n")).withColumn("curve_index", _curve_index(F.col("axes"), len(dimensions), bits))
    along = Window.orderBy("curve_index")  # over at most 65,536 cells
    cells = cells.select("axes", "curve_index", (F.sum("n").over(along) - F.col("n")).alias("cell_from"), F.sum("n").over(Window.partitionBy()).alias("n_rows"))
    inside = Window.partitionBy("axes").orderBy("part")
    groups = sizes.withColumn("part_from", F.sum("n").over(inside) - F.col("n")).drop("n")
    groups = settle(groups.join(cells, "axes").select(F.col("axes").alias("own_axes"), F.col("part").alias("own_part"), "curve_index", "n_rows", (F.col("cell_from") + F.col("part_from")).alias("from")))
    order = Window.partitionBy("axes", "part").orderBy("mixed", *key)
    ranked = placed.withColumn("nth", F.row_number().over(order) - 1)
    joined = ranked.join(groups, (F.col("axes") == F.col("own_axes")) & (F.col("part") == F.col("own_part")))
    return joined.withColumn("rank", F.col("from") + F.col("nth")).drop("axes", "part", "mixed", "nth", "from", "own_axes", "own_part")


def hilbert_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve_index):
    ``docs`` in ``shards`` runs of the curve through size, source, language and
    sixteenths of the ids' range, equal counts but for one."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", F.octet_length(data).cast("long").alias("bytes"), F.crc32(data).alias("text_crc32"), "source", "lang")
    narrow = narrow.withColumn("size", F.col("bytes") + 1).drop("bytes")

    def few(c: str) -> Column:
        return F.crc32(F.coalesce(F.col(c), F.lit("")).cast("binary")) % 16

    size_class = F.least(F.greatest(F.floor(F.log2(F.col("size").cast("double"))) - 4, F.lit(0)), F.lit(15))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    reach = max((high or 0) - (low or 0) + 1, 1)
    age = F.floor((F.coalesce("doc_id", F.lit(low or 0)) - F.lit(low or 0)).cast("double") * 16 / reach)
    ranked = hilbert_rank(narrow, [size_class, few("source"), few("lang"), F.least(age, F.lit(15))], 4, ["doc_id", "size", "text_crc32"])
    shard = F.expr(f"(({shards} * (rank + 1) - 1) div n_rows)")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        (F.col("rank") - F.expr(f"(({shards} * (rank + 1) - 1) div n_rows) * n_rows div {shards}")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve_index",
    )
