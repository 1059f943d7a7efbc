"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    # also the last shuffle of what is kept in memory
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
}


def get_session(app: str = "breezeline", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library relies on.

    On a cluster, size ``spark.sql.shuffle.partitions`` for the largest
    shuffle; adaptive execution merges what turns out too small.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        # a repeated JSON key keeps its last value
        "spark.sql.variant.allowDuplicateKeys": "true",
        # column expressions need no record of the Python line they came from
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # keyed state spills to local disk instead of filling the heap
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Only a local master, which has no other machines to share with, may fall
    back to a temporary folder.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if base:
        return f"{base.rstrip('/')}/breezeline-{uuid.uuid4().hex}"
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="breezeline-")
    raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")


@contextmanager
def adaptive(spark: SparkSession) -> Iterator[None]:
    """Adaptive execution inside the block, and what was set before after it.

    A stream with state runs in a session of its own without it, since the
    partitions of the state must stay as they are. What ``foreachBatch`` does
    with a finished batch has no state: there small partitions are merged, and
    hints to rebalance, which are ignored without it, even out the files.
    """
    before = {key: spark.conf.get(key) for key in ADAPTIVE}
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
