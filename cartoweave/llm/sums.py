"""Sums of fixed-size matrices over all tasks, added on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCK = 1024
#: Tasks whose blocks are added in one group of the first level.
FAN = 64


def matrix_sum(rows: DataFrame, make: Callable[[pa.RecordBatch, np.ndarray], None], height: int, width: int) -> np.ndarray:
    """The sum over all batches of the (height x width) matrices that ``make`` adds to, in float64.

    One matrix leaves each task, cut into blocks of rows. Blocks are added on the executors in two levels (at most ``FAN``
    tasks of one block, then these sums), so no group grows with the number of tasks as it would in one; only the sum, whose
    size the caller fixes, reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width), np.float64)
        for b in batches:
            make(b, total)
        context = TaskContext.get()
        salt = context.partitionId() // FAN if context else 0
        for i in range(0, height, BLOCK):
            part = total[i : i + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([salt], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "salt", "m"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(m.as_py(), np.float64) for m in table.column("m"))
        return pa.table({"block": table.column("block")[:1].cast(pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((height, width))
    sums = rows.mapInArrow(run, "block int, salt int, m binary").groupBy("block", "salt").applyInArrow(add, "block int, m binary")
    for block, m in sums.groupBy("block").applyInArrow(add, "block int, m binary").collect():
        part = np.frombuffer(bytes(m), np.float64).reshape(-1, width)
        out[block : block + len(part)] = part
    return out
