"""Files as captures, lines or records.

The format and the codec are told by a path's extensions. What Spark reads in
parallel by itself (lines, JSON Lines) is read so; a file that is one document is
one row, of at most 64 MiB.
"""

from __future__ import annotations

import json
import math
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parse import ltsv_rows
from ..operators.workers import reach_workers

#: Formats by extension.
FORMATS = {".csv": "csv", ".tsv": "tsv", ".ltsv": "ltsv", ".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json", ".yaml": "yaml", ".yml": "yaml"}
#: Bytes of a table that may be dealt out.
SMALL_TABLE = 1 << 30
CODECS = {".gz": "gzip", ".bz2": "bzip2"}


def table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. A row group is one task's, so a table of fewer files than
    there are cores, and of few bytes, is dealt out first; a large one never is."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    few = len(df.inputFiles()) < cores
    small = few and int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SMALL_TABLE
    return df.repartition(cores) if small else df


def format_of(path: str) -> tuple[str | None, str | None]:
    """(format, codec) by the extensions; a dotfile's whole name is none."""
    stem, last = os.path.splitext(os.path.basename(path))
    codec = CODECS.get(last.lower())
    if codec:
        stem, last = os.path.splitext(stem)
    return (FORMATS.get(last.lower()) if stem else None), codec


def evidence(path: Column) -> tuple[Column, Column]:
    """Names of parser and variant that a path like /etc/fstab suggests."""
    parent, name = F.element_at(F.split(path, "/"), -2), F.element_at(F.split(path, "/"), -1)
    return parent, F.translate(name, "._", "--")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one capture."""
    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("capture_id"), F.col("value").alias("text"))
    return df


def lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """(path, value): each line of the files; with ``\\x00``, each NUL-ended record."""
    df = spark.read.text(path, lineSep=separator).withColumn("path", F.input_file_name())
    if separator == "\n":
        df = df.withColumn("value", F.regexp_replace("value", r"\r\z", ""))
    return df.select("path", "value")


def json_refusal(text: Column) -> Column:
    """Why a text isn't one JSON value: no value, a key twice, text after it, or
    half of a pair of escapes for one character."""
    value = F.try_parse_json(text)
    # the parser stops at the end of the first value; a value in brackets shows what follows it
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    one = F.try_variant_get(alone, "$[1]", "variant").isNull()
    single = F.regexp_replace(F.regexp_replace(text, r"\\\\", ""), r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}", "")
    torn = F.contains(text, F.lit("\\u")) & single.rlike(r"\\u[dD][89a-fA-F]")
    return F.when(value.isNull(), F.lit("not JSON")).when(alone.isNull() | ~one, F.lit("text after the value")).when(torn, F.lit("half of a surrogate pair"))


def json_documents(captures: DataFrame) -> DataFrame:
    """(capture_id, json, refusal): each text as one JSON value, its keys in their
    order and its digits as they are written; white space around it is left out."""
    bare = F.btrim("text", F.lit(" \t\r\n"))
    return captures.select("capture_id", bare.alias("json"), json_refusal(bare).alias("refusal"))


def texts(captures: DataFrame) -> DataFrame:
    """(capture_id, value, refusal): each text as one string, without a BOM."""
    bare = F.when(F.startswith("text", F.lit("\ufeff")), F.substring("text", 2, 1 << 30)).otherwise(F.col("text"))
    return captures.select("capture_id", bare.alias("value"), F.when(~F.is_valid_utf8("text"), F.lit("not UTF-8")).alias("refusal"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, refusal): each non-blank line with its digits as written."""
    df = lines(spark, path).filter(F.col("value") != "")
    return df.select("path", F.col("value").alias("text"), json_refusal(F.col("value")).alias("refusal"))


def ltsv_lines(spark: SparkSession, path: str) -> DataFrame:
    df = lines(spark, path).filter(F.col("value") != "")
    return ltsv_rows(df.select(F.col("path").alias("capture_id"), F.lit(None).cast("long").alias("num"), F.col("value").alias("line")))


def rectangular_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A CSV file whose rows are known to be all of one length, by Spark's reader:
    every column a string. Unquoted empty cells come as null."""
    return spark.read.csv(path, header=True, sep=separator, quote='"', escape='"', multiLine=True, mode="FAILFAST", inferSchema=False)


#: Plain scalars of YAML's core schema.
YAML_NULLS, YAML_TRUE, YAML_FALSE = ("", "~", "null", "Null", "NULL"), ("true", "True", "TRUE"), ("false", "False", "FALSE")
YAML_INT, YAML_BASES = r"[-+]?[0-9]+", {"0o": 8, "0x": 16}
YAML_FLOAT = r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?"
YAML_NO_NUMBER = r"[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)"


def yaml_scalar(text: str) -> object:
    """What a plain scalar means; a whole number keeps all its digits. One that
    JSON can't tell is a ValueError."""
    if text in YAML_NULLS:
        return None
    if text in YAML_TRUE + YAML_FALSE:
        return text in YAML_TRUE
    if re.fullmatch(YAML_NO_NUMBER, text):
        raise ValueError(f"{text} isn't a number in JSON")
    if re.fullmatch(YAML_INT, text):
        return int(text)
    if re.fullmatch("0o[0-7]+|0x[0-9a-fA-F]+", text):
        return int(text[2:], YAML_BASES[text[:2]])
    if re.fullmatch(YAML_FLOAT, text):
        if math.isinf(value := float(text)):
            raise ValueError(f"{text} is too large")
        return value
    return text


def _yaml_value(node) -> object:
    """A composed YAML node as what JSON holds."""
    if node.id == "scalar":
        return node.value if node.style else yaml_scalar(node.value)
    if node.id == "sequence":
        return [_yaml_value(x) for x in node.value]
    made: dict[str, object] = {}
    for key, value in node.value:
        if key.id != "scalar":
            raise ValueError("a key that isn't a scalar")
        if key.value in made:
            raise ValueError(f"the key {key.value} twice")
        made[key.value] = _yaml_value(value)
    return made


def yaml_documents(df: DataFrame) -> DataFrame:
    """``df`` (capture_id, text) with json, for one YAML document of block and flow
    maps, lists and core scalars, where PyYAML is there. An empty text is null. A
    second document, anchors, aliases, tags, a key twice, numbers that JSON can't
    hold and a null text are refused."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML") from e

    @F.pandas_udf("json string, refusal string")
    def read(texts):
        import pandas as pd

        out = []
        for t in texts:
            try:
                if t is None:
                    raise ValueError("no text")
                if any(isinstance(x, (yaml.AliasToken, yaml.AnchorToken, yaml.TagToken)) for x in yaml.scan(t)):
                    raise ValueError("anchors, aliases and tags aren't read")
                node = yaml.compose(t, yaml.BaseLoader)
                made = None if node is None else _yaml_value(node)
                out.append((json.dumps(made, ensure_ascii=False, separators=(",", ":")), None))
            except (yaml.YAMLError, ValueError, RecursionError) as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["json", "refusal"])

    reach_workers(df.sparkSession)
    return df.withColumn("read", read("text")).select("*", "read.json", "read.refusal").drop("read")
