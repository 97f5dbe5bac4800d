"""A function called for each row, for what it does: the count of rows, and an end at the first failure.

Tasks return their counts and the row that failed, nothing else. One failure is asked for, so Spark runs one partition, then some
times as many (`spark.sql.limit.scaleUpFactor`), until it has one: partitions behind the wave of a failure never start, and without
a failure each runs once. A task whose row failed ends there and is not tried again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import VisitError

#: Rows of an Arrow batch that are Python objects at once.
HELD = 1024


def visit(rows: DataFrame, function: Callable[[dict], object]) -> int:
    """How many rows the function was called for. Where it raises, VisitError says for which row, why, and for how many it went well.

    Of several failures of one wave the first partition's is reported. Calls run in tasks, in parallel; where an executor is lost, its
    tasks run again, and with them the calls. What the function returns is ignored. Without rows the count is 0.
    """
    schema = pa.schema([("n", pa.int64()), ("row", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, failed, why = 0, None, None
        for b in batches:
            for i in range(0, b.num_rows if why is None else 0, HELD):
                for row in b.slice(i, HELD).to_pylist():
                    try:
                        function(row)
                    except Exception as e:  # the user's, whatever it is: reported with its row
                        failed, why = json.dumps(row, default=str), f"{type(e).__name__}: {e}"
                        break
                    n += 1
                if why is not None:
                    break
            if why is not None:
                break
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([failed], pa.string()), pa.array([why], pa.string())], schema=schema)

    seen = Observation()
    done = rows.mapInArrow(run, "n long, row string, error string").observe(seen, F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    failures = done.where(F.col("error").isNotNull()).take(1)
    n = seen.get["n"]
    if failures:
        raise VisitError(json.loads(failures[0].row), failures[0].error, n)
    return n
