"""Batch inference: a caller's function over rows, with a cache, retries, and errors as a column."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Overloaded(Exception):
    """Raised by a client that should be asked again later."""


def ask(client: Callable[[str], str], prompt: str, tries: int, pause: float) -> tuple[str | None, str | None]:
    """(answer, error); overload is retried after pause * 2**attempt seconds and a random share more."""
    for attempt in range(tries):
        try:
            return client(prompt), None
        except Overloaded as error:
            if attempt + 1 == tries:
                return None, f"overloaded: {error}"
            time.sleep(pause * 2**attempt * (1 + random.random() / 4))
        except Exception as error:  # noqa: BLE001  the row carries it
            return None, f"{type(error).__name__}: {error}"
    return None, "not tried"


def map_model(rows: DataFrame, make_client: Callable[[], Callable[[str], str]], key: str, prompt: str, cache: DataFrame | None = None, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """key, answer, error of every row; rows whose key the cache (key, answer) has are not asked.

    The client is made once per partition; as many partitions as there are, so many run at a time.
    """
    asked = rows.select(key, prompt)
    if cache is not None:
        asked = asked.join(cache.select(key), key, "left_anti").select(key, prompt)

    def run(batches):
        client = make_client()
        for batch in batches:
            told = [ask(client, p, tries, pause) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in told], pa.string()), pa.array([e for _, e in told], pa.string())], names=[key, "answer", "error"])

    kind = rows.schema[key].dataType.simpleString()
    fresh = asked.mapInArrow(run, f"`{key}` {kind}, answer string, error string")
    if cache is None:
        return fresh
    held = rows.select(key).join(cache.select(key, "answer"), key).select(key, "answer", F.lit(None).cast("string").alias("error"))
    return fresh.union(held)


def accept_title(answer, most: int = 50):
    """The first line of an answer if it is short enough, else null."""
    line = F.trim(F.split_part(F.trim(answer), F.lit("\n"), F.lit(1)))
    return F.when((line != "") & (F.length(line) <= most), line)
