"""Captures of what commands print, taken by the driver and landed as rows."""

from __future__ import annotations

import os
import platform
import selectors
import signal
import subprocess
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

MOST_OUTPUT = 64 << 20


def _run(argv: Sequence[str], timeout: float, most: int) -> tuple[int | None, str | None, str | None]:
    """(status, text, error) of a command, whose output is read as it comes and
    ended beyond ``most`` bytes, so that no more is ever held."""
    done, out = time.monotonic() + timeout, bytearray()
    with subprocess.Popen(list(argv), stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env={**os.environ, "LC_ALL": "C"}, start_new_session=True) as process:
        with selectors.DefaultSelector() as ready:
            ready.register(process.stdout, selectors.EVENT_READ)
            while True:
                if not ready.select(max(done - time.monotonic(), 0)):
                    os.killpg(process.pid, signal.SIGKILL)
                    return None, None, f"not done within {timeout:g} seconds"
                piece = os.read(process.stdout.fileno(), 1 << 16)
                if not piece:
                    break
                out += piece
                if len(out) > most:
                    os.killpg(process.pid, signal.SIGKILL)
                    return None, None, f"over {most} bytes of output"
        try:
            status = process.wait(max(done - time.monotonic(), 0))
        except subprocess.TimeoutExpired:
            os.killpg(process.pid, signal.SIGKILL)
            return None, None, f"not done within {timeout:g} seconds"
    ended = f"ended by {signal.Signals(-status).name}" if status < 0 else None
    return status, out.decode("utf-8", "replace"), ended


def captured(spark: SparkSession, commands: Sequence[Sequence[str]], timeout: float = 60, most: int = MOST_OUTPUT) -> DataFrame:
    """Runs each command, without a shell and with LC_ALL=C: capture_id, argv,
    os, status (negative: the signal that ended it), text and error. Output beyond
    ``most`` bytes, or time, ends a command and what it started. It is a utility
    of the driver, for a few commands."""
    rows = []
    for k, argv in enumerate(commands):
        try:
            status, text, error = _run(argv, timeout, most)
        except OSError as e:
            status, text, error = None, None, str(e)
        rows.append((k, list(argv), platform.system().lower(), status, text, error))
    return spark.createDataFrame(rows, "capture_id long, argv array<string>, os string, status int, text string, error string")
