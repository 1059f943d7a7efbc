"""Memory that Python workers give back between batches, and the driver after training.

A worker lives on after its task, as the driver does. What it has freed stays with its
allocators and would count against the executor's memory while other stages run. The
executor keeps its largest Arrow batches in the same way, outside its heap, so these are small.
"""

from __future__ import annotations

import ctypes
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import SparkSession

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20  # of rows sent to Python at once; a larger row is a batch of its own


def small_batches(spark: SparkSession):
    """From now on this session sends rows to Python ``BATCH_BYTES`` at a time, or less if it is set to less.

    Spark's default is 64 MB, and for every task an executor holds some batches at once. Rows
    are sent when a result is written, so the setting stays.
    """
    number, unit = re.match(r"(\d+)([kmg]?)", spark.conf.get(ARROW_BYTES).strip().lower()).groups()
    if int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] > BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def give_back():
    """Free memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(run):
    """The same function over batches; free memory goes back to the system after each result and at the end."""

    def wrapped(batches):
        try:
            for out in run(batches):
                yield out
                del out
                give_back()
        finally:
            give_back()

    return wrapped
