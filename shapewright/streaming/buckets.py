"""New lines of many captures handed to Python at once.

Spark hands each key's lines to Python by themselves, which costs some 5 ms of a
core whatever they are. So the key is a bucket of captures, by the hash of the id,
and what a bucket keeps is the text that each open capture keeps; those without new
lines pass through unread. A batch hands over at most ``BUCKETS`` keys; a bucket's
new lines of one batch are in memory together, and what its open captures keep is
one row of state, under 2 GB.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Line = tuple[int, str]
#: What a capture's new lines, and whether they are its last, give: rows, and what it keeps; it was given what it kept before (None: nothing).
Handle = Callable[[object, list[Line], bool], tuple[list[tuple], object]]
#: What a capture kept, its new lines, and whether they are its last.
Capture = tuple[object, list[Line], bool]
#: The same of a bucket's captures one after another, which may look at many at once.
Handles = Callable[[Iterator[Capture]], Iterator[tuple[list[tuple], object]]]
BUCKETS = 1024
#: Rows that are handed back at a time.
ROWS = 10_000
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _as_text(kind: T.DataType) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """An id as a text that no other has, and back."""
    if isinstance(kind, (T.StringType, T.NumericType, T.BooleanType, T.DateType)):
        return lambda c: c.cast("string"), lambda c: c.cast(kind)
    whole = T.StructType([T.StructField("id", kind)])
    return lambda c: F.to_json(F.struct(c.alias("id")), TIMES), lambda c: F.from_json(c, whole, TIMES)["id"]


def one_by_one(handle: Handle) -> Handles:
    """Handles captures each by itself."""
    return lambda captures: (handle(*c) for c in captures)


def _handled(handle: Handle, columns: Sequence[str], together: bool = False):
    """Handles a bucket's new lines; ``together`` if ``handle`` is of ``Handles``."""
    handles = handle if together else one_by_one(handle)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = dict(zip(*state.get, strict=True)) if state.exists else {}
        new: dict[str | None, tuple[list[Line], list[bool]]] = {}
        for frame in frames:
            for of, num, line, last in zip(frame["of"].tolist(), frame["num"].tolist(), frame["line"].tolist(), frame["last"].tolist(), strict=True):
                if of not in new:
                    new[of] = ([], [])
                if line is not None:
                    new[of][0].append((num, line))
                if last:
                    new[of][1].append(True)
        out: list[tuple] = []
        before = {of: kept.pop(of) for of in new if of in kept}
        captures = ((json.loads(before[of]) if of in before else None, sorted(lines), bool(ends)) for of, (lines, ends) in new.items())
        for (of, (_, ends)), (rows, after) in zip(new.items(), handles(captures), strict=True):
            out += [(of, *r) for r in rows]
            if not ends:
                kept[of] = json.dumps(after)
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=["of", *columns])
                out = []
        if kept:
            state.update((list(kept), list(kept.values())))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["of", *columns])

    return run


def by_bucket(lines: DataFrame, handle: Handle | Handles, out: str, buckets: int = BUCKETS, together: bool = False) -> DataFrame:
    """capture_id and the columns ``out`` of what ``handle`` makes of each capture's
    new lines; ``together`` if it takes a bucket's captures."""
    to, back = _as_text(lines.schema["capture_id"].dataType)
    columns = [c.split(" ")[0] for c in out.split(", ")]
    keyed = lines.select(to(F.col("capture_id")).alias("of"), "num", "line", "last")
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("of"), F.lit(buckets)))
    made = keyed.groupBy("bucket").applyInPandasWithState(_handled(handle, columns, together), f"of string, {out}", "captures array<string>, kept array<string>", "append", GroupStateTimeout.NoTimeout)
    return made.select(back(F.col("of")).alias("capture_id"), *columns)
