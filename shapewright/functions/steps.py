"""Columns made step by step, each computed once however often later ones name it.

The steps that read one line are the same for a table of lines, where each is a
projection, and for an array of lines, where each is a struct bound in a lambda.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

#: From the columns so far, by name, to more of them.
Step = Callable[[Mapping[str, Column]], Mapping[str, Column]]


def held(value: Column) -> Column:
    """``value``, not to be computed again where it is used: what is chosen by the
    partition's number, which never is below 0, counts as not deterministic, so
    the optimiser moves no filter on it below its projection."""
    return F.when(F.spark_partition_id() >= 0, value)


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    return F.col(quoted_name(name))


def projected(df: DataFrame, keep: Sequence[str], steps: Sequence[Step], first: Mapping[str, Column]) -> DataFrame:
    """``df`` with the columns of all steps, which are named ``step name`` so that
    they clash with none that is kept; ``first`` is what the first step reads."""
    df = df.select(*[quoted(k) for k in keep], *[c.alias(f"0 {n}") for n, c in first.items()])
    names = {n: f"0 {n}" for n in first}
    for number, step in enumerate(steps, 1):
        new = {n: c.alias(f"{number} {n}") for n, c in step({n: quoted(at) for n, at in names.items()}).items()}
        df = df.select("*", *new.values())
        names.update({n: f"{number} {n}" for n in new})
    return df.select(*[quoted(k) for k in keep], *[quoted(at).alias(f" {n}") for n, at in names.items()])


def bound(first: Mapping[str, Column], steps: Sequence[Step], last: Callable[[Mapping[str, Column]], Column]) -> Column:
    """The same inside an expression: ``last`` of the columns of all steps."""

    def at(env: Mapping[str, Column], rest: Sequence[Step]) -> Column:
        if not rest:
            return last(env)
        new = rest[0](env)
        if not new:
            return at(env, rest[1:])
        return let(F.struct(*[c.alias(n) for n, c in new.items()]), lambda s: at({**env, **{n: s[n] for n in new}}, rest[1:]))

    return let(F.struct(*[c.alias(n) for n, c in first.items()]), lambda s: at({n: s[n] for n in first}, steps))
