"""Optional models and recognisers behind one interface, asked once for each distinct input.

An adapter is an object with ``ask(row: dict) -> dict`` that is made on each
worker by a factory. Answers go into a table keyed by the hash of what was
asked; a later run joins it and asks only for what it lacks. An adapter that
fails gives a row with its error, and after some failures in a row a task stops
asking and says so, so that a dead service neither ends nor stalls the run.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checks import cache_misses, reused

#: Tries of a request, seconds before the second one (doubled each time), failures in a row after which a task stops.
TRIES, PAUSE, FAILURES = 3, 0.5, 3


def request_hash(df: DataFrame, columns: list[str], version: str) -> Column:
    """The hash that a request is remembered by: of its columns and the version of what answers it."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("__version"), *sorted(columns)), {"ignoreNullFields": "false"}), 256)


def ask(requests: DataFrame, factory: Callable[[], object], answer: T.StructType, tries: int = TRIES, pause: float = PAUSE, failures: int = FAILURES, tasks: int | None = None) -> DataFrame:
    """(content_hash, answer's fields, error, tries) for each request; ``tasks`` bounds how many requests are open at once."""
    schema = T.StructType([T.StructField("content_hash", T.StringType()), *answer.fields, T.StructField("error", T.StringType()), T.StructField("tries", T.IntegerType())])
    names = answer.fieldNames()

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, adapter, broken = to_arrow_schema(schema), factory(), 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                result, error, n = {}, None, 0
                if broken >= failures:
                    error = "not asked: too many failures in a row"
                while error is None and n < tries:
                    n += 1
                    try:
                        result = adapter.ask(row) or {}
                        break
                    except Exception as e:  # whatever the adapter raises is an answer that failed
                        result = {}
                        if n == tries:
                            error, broken = f"{type(e).__name__}: {e}", broken + 1
                        else:
                            time.sleep(pause * 2 ** (n - 1))
                if n and error is None:
                    broken = 0
                out.append({"content_hash": row["content_hash"], "error": error, "tries": n} | {k: result.get(k) for k in names})
            if out:
                yield pa.RecordBatch.from_pylist(out, target)

    d = requests if tasks is None else requests.repartition(tasks)
    return d.mapInArrow(run, schema)


def answered(inputs: DataFrame, columns: list[str], factory: Callable[[], object], answer: T.StructType, cache: DataFrame | None = None, version: str = "1", **limits) -> tuple[DataFrame, DataFrame]:
    """(inputs with answers, error, tries and ``cache_hit``; the fresh answers, cut, to be added to the cache).

    Equal inputs are asked once. Failed answers aren't to be cached; they are in
    the second table with their error.
    """
    from ..functions.lineage import cut

    d = inputs.withColumn("content_hash", request_hash(inputs, columns, version))
    known = cache if cache is not None else d.sparkSession.createDataFrame([], T.StructType([T.StructField("content_hash", T.StringType()), *answer.fields]))
    fresh = cut(ask(cache_misses(d.select("content_hash", *columns), known), factory, answer, **limits))
    return reused(d, known.select("content_hash", *answer.fieldNames()), fresh), fresh
