"""Tables that cut lineage, written to the shared folder named by spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Only a local session may go without the setting: it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="orrery-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_within: ContextVar[str | None] = ContextVar("within", default=None)


class Scratch:
    """Written tables of one run of an operator.

    `discard` removes a table that a loop has replaced, `keep` all but those that a lazy
    result still reads. These stay until the cluster clears its folder, or until the end of
    the block `inside` of a caller that owns what the operators in it write.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{_within.get() or shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.made = 0
        self.tables: dict[str, DataFrame] = {}

    @contextmanager
    def inside(self, label: str) -> Iterator[None]:
        """All that operators write in this block goes at its end; their results must have been written by then."""
        path = f"{self.root}/{label}"
        before = _within.set(path)
        try:
            yield
        finally:
            _within.reset(before)
            self._delete(path)

    def save(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self.tables[path] = out
        return out

    def keep(self, *wanted: DataFrame) -> None:
        paths = {df.scratch_path for df in wanted}
        for path, df in list(self.tables.items()):
            if path not in paths:
                self.discard(df)

    def discard(self, df: DataFrame | None) -> None:
        path = getattr(df, "scratch_path", None)
        if self.tables.pop(path, None) is not None:
            self._delete(path)

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
