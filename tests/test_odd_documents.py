"""Texts that the driver's tables lack: null, empty, ended by a newline, of one id, with white space of other kinds."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import TABLES, same
from pyspark.sql import functions as F

from conftest import SMALL
from shapewright import queries
from shapewright.functions.text import SPACES
from shapewright.operators.lines import Region, regioned

BODY = "the a\n\nb c\nThe les"
ODD = {
    "null": [(1, BODY), (2, None)],
    "empty": [(1, ""), (2, BODY)],
    "newline at the end": [(1, BODY + "\n"), (2, "a\n\n"), (3, "\n"), (4, "\n\n\n")],
    "one id": [(1, BODY), (1, "q"), (1, None), (2, "q\n"), (2, "q\n")],
    "no id": [(None, BODY), (None, "x\n"), (None, "")],
    "carriage returns": [(1, "a\r\nthe\r\n\r\nb"), (2, "\r"), (3, "\ra"), (4, " \r\n \r")],
    "white space": [(1, "a\n\t\nb\n \t \nc"), (2, "a\n 　 \n \n\x0b\n\x0c\n\x85\n \n​\nb")],
    "byte order marks": [(1, "﻿the"), (2, "﻿"), (3, "﻿ "), (4, "a\n﻿")],
    "none": [],
}


def folder(tmp_path, rows):
    """The small tables, with other documents."""
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    texts = {"doc_id": pa.array([k for k, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}
    pq.write_table(pa.table(texts), tmp_path / "documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("kind", list(ODD))
def test_accounting_equals_its_sql_on_odd_texts(spark, tmp_path, kind):
    at = folder(tmp_path, ODD[kind])
    same(queries.QUERIES["lines_accounting"](spark, at), queries.ORACLES["lines_accounting"], at)


def test_lines_verbatim_and_blank_by_spaces(spark):
    texts = spark.createDataFrame([(1, "﻿a\r\n\t\n  \nb")], "capture_id long, text string")
    account = F.struct("account.lines", "account.blank", "account.selected").alias("a")
    told = lambda df: [(tuple(r.a), [v.text for v in r.lines]) for r in df.select(account, "lines").collect()]
    assert told(regioned(texts, Region())) == [((4, 2, 2), ["a", "b"])]
    assert told(regioned(texts, Region(), white=SPACES, verbatim=True)) == [((4, 1, 3), ["﻿a\r", "\t", "b"])]
