"""Shapes and signatures read from text: JSON, or YAML where PyYAML is there.

A definition is a mapping with ``shape`` (the fields of Shape), and optionally
``signature`` (the fields of Signature but for the name and the source). Keys
that are unknown, or of the wrong kind, are refused, all of them at once. A
registry is a folder of ``<command>/<variant>/parser.json`` (or ``.yaml``); a
file that is wrong is told and left out, and the others stand.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.convert import Field
from ..operators.lines import Region
from .identify import Signature
from .shape import DefinitionError, Shape

#: Bytes of one definition, at most.
MOST_DEFINITION = 1 << 20
#: Fields of a rule that are the reader's to assume, not the definition's to say.
ASSUMED = ("year", "recent", "zones")


@dataclass(frozen=True)
class Definition:
    """A shape and what identifies a text of it."""

    shape: Shape
    signature: Signature | None = None


def _once(pairs: list[tuple[str, object]]) -> dict:
    made = dict(pairs)
    if len(made) < len(pairs):
        raise ValueError("a key that stands twice")
    return made


def _parsed(text: str, kind: str) -> object:
    if len(text.encode()) > MOST_DEFINITION:
        raise DefinitionError("a definition of over 1 MiB")
    try:
        if kind == "json":
            return json.loads(text, object_pairs_hook=_once)
        import yaml

        return yaml.safe_load(text)
    except ImportError as e:
        raise DefinitionError("reading YAML needs PyYAML") from e
    except (ValueError, RecursionError) as e:
        raise DefinitionError(f"not {kind}: {e}") from e
    except Exception as e:  # PyYAML's errors have no common builtin base
        raise DefinitionError(f"not {kind}: {e}") from e


def _plain(value: object, default: object, at: str, problems: list[str]) -> object:
    """A value that is no mapping of its own, checked by the kind of its default."""
    if isinstance(default, bool) or default is None:
        good = isinstance(value, (bool,)) if isinstance(default, bool) else not isinstance(value, (list, dict))
    elif isinstance(default, int):
        good = isinstance(value, int) and not isinstance(value, bool)
    elif isinstance(default, str):
        good = isinstance(value, str)
    else:
        good = isinstance(value, list)
    if not good:
        problems.append(f"{at}: {type(value).__name__} isn't of the kind that it takes")
    return tuple(tuple(v) if isinstance(v, list) else v for v in value) if isinstance(value, list) else value


def _made(kind: type, given: object, at: str, problems: list[str], taken: tuple[str, ...] = ()):
    """An instance of a dataclass by a mapping's keys."""
    if not isinstance(given, Mapping):
        problems.append(f"{at}: not a mapping")
        return None
    known = {f.name for f in fields(kind)} - {*taken, *(ASSUMED if kind is Field else ())}
    problems += [f"{at}.{k}: unknown" for k in given if k not in known]
    values = {}
    for name, value in given.items():
        if name not in known:
            continue
        here = f"{at}.{name}"
        if kind is Shape and name == "region":
            values[name] = _made(Region, value, here, problems)
        elif name in ("fields", "parts") and kind in (Shape, Field):
            inner = Shape if name == "parts" else Field
            if not isinstance(value, Mapping):
                problems.append(f"{here}: not a mapping")
                continue
            values[name] = {k: _made(inner, v, f"{here}.{k}", problems) for k, v in value.items()}
        elif kind is Shape and name == "node":
            values[name] = _made(Shape, value, here, problems)
        elif kind is Field and name == "items":
            values[name] = _made(Field, value, here, problems)
        elif kind is Field and name == "unescape":
            values[name] = value if isinstance(value, Mapping) else problems.append(f"{here}: not a mapping")
        else:
            values[name] = _plain(value, getattr(kind, name, None), here, problems)
    return values if taken else kind(**values) if not any(p.startswith(at) for p in problems) else None


def definition(text: str, *, kind: str = "json", command: str = "inline", variant: str = "default", source: int = 0) -> Definition:
    """The definition that a text tells; DefinitionError lists every problem."""
    given = _parsed(text, kind)
    problems: list[str] = []
    if not isinstance(given, Mapping) or "shape" not in given:
        raise DefinitionError("shape: missing")
    problems += [f"{k}: unknown" for k in given if k not in ("shape", "signature")]
    if isinstance(given["shape"], Mapping) and "parse" not in given["shape"]:
        problems.append("shape.parse: missing")
    shape = _made(Shape, given["shape"], "shape", problems) if not problems else None
    if shape is not None:
        problems += shape.problems()
    signature = _made(Signature, given["signature"], "signature", problems, ("parser", "variant", "source")) if "signature" in given else None
    if problems:
        raise DefinitionError("; ".join(problems))
    return Definition(shape, Signature(command, variant, source, **signature) if signature is not None else None)


def disabled(spark: SparkSession, path: str, source: int = 0) -> DataFrame:
    """(parser, variant, source) of what a folder's manifest.json disables in the
    sources after it, for ``identify.without_disabled``: a list ``disable`` of
    commands (variant null) and command/variant pairs. No manifest disables nothing."""
    files = spark.read.option("pathGlobFilter", "manifest.json").text(path, wholetext=True)
    rows: list[tuple[str, str | None, int]] = []
    for row in files.toLocalIterator():
        given = _parsed(row.value, "json")
        names = given.get("disable", []) if isinstance(given, Mapping) else None
        if not isinstance(names, list) or not all(isinstance(n, str) and re.fullmatch(r"[a-z0-9][a-z0-9-]*(?:/[a-z0-9][a-z0-9-]*)?", n) for n in names):
            raise DefinitionError("manifest.json: disable isn't a list of commands and command/variant pairs")
        rows += [(*([*n.split("/"), None][:2]), source) for n in names]
    return spark.createDataFrame(rows, "parser string, variant string, source int")


def registry(spark: SparkSession, path: str, source: int = 0) -> tuple[dict[tuple[str, str], Definition], dict[str, str]]:
    """The definitions of a folder by (command, variant), and by file what is
    wrong with the others. Definitions are read by the driver, as patterns that
    plans are made of; they are few and at most 1 MiB each."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "parser.*").text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    good, bad = {}, {}
    for row in sorted(files.toLocalIterator(), key=lambda r: r.path):
        place = re.search(r"([a-z0-9][a-z0-9-]*)/([a-z0-9][a-z0-9-]*)/parser\.(json|yaml)\Z", row.path)
        if not place:
            bad[row.path] = "not at <command>/<variant>/parser.json or .yaml"
            continue
        command, variant, kind = place.groups()
        try:
            good[command, variant] = definition(row.value, kind=kind, command=command, variant=variant, source=source)
        except DefinitionError as e:
            bad[row.path] = str(e)
    return good, bad
