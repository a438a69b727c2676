"""Session settings of streams: the state store of keyed state, and what the batches of a trigger broadcast."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
_MEASURED = "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Queries started in the block use RocksDB for their state; the session's setting returns after it."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins planned in the block become broadcasts by the size that was shuffled, not by that of compressed files.

    The rows of 10 MB of addresses in files take hundreds of MB on the driver, and a trigger has many such tables.
    """
    most = spark.conf.get(_BROADCAST)
    wanted = {_BROADCAST: "-1", _MEASURED: spark.conf.get(_MEASURED, most)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
