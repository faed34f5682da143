"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlane.session import checkpoint_dir, prepare

# Texts may be long: batches to Python workers are small, so that a batch fits
# beside its results. Changed only where they are at Spark's defaults.
_BATCH = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "512"),)


def ready(spark: SparkSession) -> SparkSession:
    """Prepare a session for the operators."""
    prepare(spark)
    for key, default, better in _BATCH:
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, better)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: Column | str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


class Shared:
    """A broadcast value, with a name by which a worker knows what it built from it."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.key, self.data = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self) -> object:
        return self.data.value


_built: dict[str, tuple[object, object]] = {}


def once(kind: str, key: object, build: Callable[[], object]) -> object:
    """What ``build`` makes, kept in the worker process until another ``key`` of the kind comes."""
    if kind not in _built or _built[kind][0] != key:
        _built.pop(kind, None)
        _built[kind] = (key, build())
    return _built[kind][1]


def file_bytes(spark: SparkSession, path: str) -> Shared:
    """A vocabulary file of the driver, sent to the executors (its size does not depend on any table)."""
    with open(path, "rb") as file:
        return Shared(spark, file.read())


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of equal ``keys`` of rows that arrive in key order, one frame each."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        change = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
        change[0] = bool(held) and bool((held[-1][keys].iloc[-1] != batch[keys].iloc[0]).any())
        start = 0
        for at in change.nonzero()[0]:
            if at > start:
                held.append(batch.iloc[start:at])
            if held:
                yield pd.concat(held, ignore_index=True)
            held, start = [], at
        held.append(batch.iloc[start:])
    if held:
        yield pd.concat(held, ignore_index=True)
