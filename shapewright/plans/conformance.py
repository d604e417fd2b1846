"""What a definition must withstand, as DataFrames made of captures.

``dressed`` gives texts that must be read alike; ``tampered`` gives texts with a
foreign line, which must be refused; ``strangers`` tells definitions that claim
captures that are not theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .identify import Signature, candidates, identified

#: A line that no definition should read.
FOREIGN = "¿?! no line of this format !?¿"


def _variants(captures: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    made = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("text")) for k, v in kinds.items()])
    others = [c for c in captures.columns if c not in ("text", "kind")]
    return captures.select(*others, F.inline(made))


def dressed(captures: DataFrame) -> DataFrame:
    """Each capture with a BOM, CRLF, no newline at its end, and blank lines
    before and after; ``kind`` names which."""
    t = F.col("text")
    bare = F.regexp_replace(t, r"\n\z", "")
    crlf = F.regexp_replace(t, r"(?<!\r)\n", "\r\n")
    return _variants(captures, {"bom": F.concat(F.lit("﻿"), t), "crlf": crlf, "no newline": bare, "blank before": F.concat(F.lit("\n"), t), "blank after": F.concat(bare, F.lit("\n\n"))})


def tampered(captures: DataFrame, foreign: str = FOREIGN) -> DataFrame:
    """Each capture with a foreign line at its end, in its middle, and twice in a row at its end."""
    lines = F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1)

    def put(count: int, at_end: bool) -> Column:
        alien = F.array(*[F.lit(foreign)] * count)

        def joined(v: Column) -> Column:
            half = F.size(v) if at_end else F.ceil(F.size(v) / 2).cast("int")
            return F.concat(F.array_join(F.flatten(F.array(F.slice(v, F.lit(1), half), alien, F.slice(v, half + 1, F.size(v)))), "\n"), F.lit("\n"))

        return let(lines, joined)

    return _variants(captures, {"end": put(1, True), "middle": put(1, False), "doubled": put(2, True)})


def strangers(captures: DataFrame, signatures: Sequence[Signature], owner: str = "owner") -> DataFrame:
    """(capture_id, parser, variant): definitions that match a capture whose
    column ``owner`` names another one; a null owner makes every match a stranger's."""
    own = captures.withColumn("capture_id", F.struct("capture_id", F.col(owner).alias("owner")))
    return candidates(own, signatures).filter(~F.col("capture_id.owner").eqNullSafe(F.col("parser"))).select("capture_id.capture_id", "parser", "variant")


def decoys(captures: DataFrame, signatures: Sequence[Signature]) -> DataFrame:
    """(capture_id, parser, variant): definitions that claim a text which only
    looks like theirs; there should be none."""
    return strangers(captures.withColumn("owner", F.lit(None).cast("string")), signatures)


def early_settled(captures: DataFrame, signatures: Sequence[Signature]) -> DataFrame:
    """(capture_id, parser, variant, early): the choice on the whole text beside
    whether its leading lines, as many as the widest window asks for, give the same."""
    widest = max(s.window for s in signatures)
    own = captures.withColumn("capture_id", F.struct("capture_id", F.col("text").alias("whole")))
    head = own.withColumn("text", F.array_join(F.slice(F.split("text", "\n", -1), 1, widest + 1), "\n"))
    chosen = identified(own, signatures).select("capture_id", F.struct("parser", "variant", "refusal").alias("late"))
    # both choices are made in the same row, so the second is read off the first one's id
    both = identified(head, signatures).select(F.col("capture_id.capture_id").alias("capture_id"), F.struct("parser", "variant", "refusal").alias("soon"))
    late = chosen.select(F.col("capture_id.capture_id").alias("own_id"), "late")
    joined = both.join(late, F.col("capture_id").eqNullSafe(F.col("own_id")))
    return joined.select("capture_id", "late.parser", "late.variant", F.col("late").eqNullSafe(F.col("soon")).alias("early"))


def compared(rows: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys`` and outcome (missing, unexpected, differs) of rows that aren't as a
    golden table tells; a row's columns are held together whatever their order."""
    columns = sorted(c for c in expected.columns if c not in keys)
    if sorted(c for c in rows.columns if c not in keys) != columns:
        raise ValueError(f"columns {sorted(rows.columns)} where {sorted(expected.columns)} are expected")
    got = rows.select(*keys, F.struct(*columns, F.lit(1).alias("there")).alias("got"))
    want = expected.select(*keys, F.struct(*columns, F.lit(1).alias("there")).alias("want"))
    both = got.join(want, list(keys), "full")
    outcome = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(~F.col("got").eqNullSafe(F.col("want")), "differs")
    return both.select(*keys, outcome.alias("outcome")).filter("outcome is not null")
