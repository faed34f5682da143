"""Micro-batches written so that a repeated batch replaces its rows.

Files lie in one folder for each query, batch and run of that batch. A run
counts once a one-row manifest names it; of several runs of a batch the last
one counts. A run that failed has no manifest, so its files are never read.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventlane.session import exists, remove, subfolders

PLACE = ("query", "batch_id", "run")
_PLACED = "query string, batch_id bigint, run string"
_MANIFEST = f"number bigint, rows_schema string, {_PLACED}"
_PLAIN = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


class BatchSink:
    """A table below ``path`` that holds each batch of ``query`` once.

    ``path`` is a folder that all executors share. Several queries may write
    below one path at the same time; a batch is written by one driver at a time.
    """

    def __init__(self, path: str, query: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        if not _PLAIN.fullmatch(query):
            raise ValueError(f"a query is named by letters, digits, '_', '.' and '-', not {query!r}")
        self.path, self.query, self.shape = path.rstrip("/"), query, shape

    def _folder(self, kind: str, batch_id: int) -> str:
        return f"{self.path}/{kind}/query={self.query}/batch_id={int(batch_id)}"

    def _last(self, spark: SparkSession, batch_id: int):
        """Manifest row of the batch's last committed run."""
        if not exists(spark, self._folder("commits", batch_id)):
            return None
        # Few rows: one for each time that this batch was written.
        rows = spark.read.schema("number bigint, rows_schema string, run string").json(self._folder("commits", batch_id))
        return rows.sort(F.desc("number"), F.desc("run")).first()

    def committed(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """Rows of the batch, or None where no run of it was finished."""
        last = self._last(spark, batch_id)
        if last is None:
            return None
        schema = StructType.fromJson(json.loads(last.rows_schema))
        return spark.read.schema(schema).parquet(f"{self._folder('data', batch_id)}/run={last.run}")

    def replace(self, df: DataFrame, batch_id: int) -> DataFrame:
        """Write the batch's rows, in place of those an earlier run left, and read them back.

        The old rows count until the new ones are whole. A batch may be empty.
        """
        df = self.shape(df)
        if clash := [c for c in df.columns if c.lower() in PLACE]:
            raise ValueError(f"columns {clash} name the place of a batch")
        spark, run = df.sparkSession, f"r-{uuid.uuid4().hex}"
        last = self._last(spark, batch_id)
        df.write.parquet(f"{self._folder('data', batch_id)}/run={run}")
        manifest = spark.range(1).select(
            F.lit((last.number if last else 0) + 1).alias("number"), F.lit(df.schema.json()).alias("rows_schema")
        )
        manifest.coalesce(1).write.json(f"{self._folder('commits', batch_id)}/run={run}")
        return spark.read.schema(df.schema).parquet(f"{self._folder('data', batch_id)}/run={run}")

    def once(self, make: Callable[[], DataFrame], spark: SparkSession, batch_id: int) -> DataFrame:
        """The batch's rows: those already committed, or else what ``make`` gives, written."""
        found = self.committed(spark, batch_id)
        return self.replace(make(), batch_id) if found is None else found

    def vacuum(self, spark: SparkSession, batch_id: int, keep_last: bool = True) -> None:
        """Remove the files of failed and replaced runs of a batch, and without ``keep_last`` all of its rows.

        Manifests stay, so a batch that was committed is not written as new.
        """
        last = self._last(spark, batch_id)
        kept = f"run={last.run}" if last and keep_last else None
        for name in subfolders(spark, self._folder("data", batch_id)):
            if name != kept:
                remove(spark, f"{self._folder('data', batch_id)}/{name}")


def read_batches(spark: SparkSession, path: str, queries: Sequence[str] = ()) -> DataFrame:
    """Rows of all committed batches below ``path``, with ``query`` and ``batch_id``.

    Manifests and files meet in a join on the partition columns, so the files of
    runs that do not count are pruned and no list of files goes through the
    driver. ``queries`` limits the reading to some writers. Where the schema
    changed between batches, columns missing in older files are null.
    """
    path = path.rstrip("/")
    if not exists(spark, f"{path}/commits"):
        raise ValueError(f"no batch was committed below {path}")
    # Numbers start at one; a condition on the manifests lets Spark prune files by them.
    manifests = spark.read.schema(_MANIFEST).json(f"{path}/commits").where("number >= 1")
    if queries:
        manifests = manifests.where(F.col("query").isin(*queries))
    # One row for each schema that was ever written.
    schemas = manifests.groupBy("rows_schema").agg(F.max(F.struct("batch_id", "number")).alias("at")).sort(F.desc("at")).collect()
    fields = {f.name: f for row in reversed(schemas) for f in StructType.fromJson(json.loads(row.rows_schema))}
    whole = StructType([*fields.values(), *StructType.fromDDL(_PLACED)])
    last = manifests.groupBy("query", "batch_id").agg(F.max_by("run", F.struct("number", "run")).alias("run"))
    return spark.read.schema(whole).parquet(f"{path}/data").join(last, list(PLACE)).drop("run")
