"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL: list[str] = []
#: Folders of working tables, the innermost last: they go when the operator that asked for one has its result.
_FOLDERS: ContextVar[tuple[str, ...]] = ContextVar("folders", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset and all run on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="stillflow-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside, but for those asked to stay, are removed at the end."""
    folder = f"{shared_dir(spark)}/stillflow/{uuid.uuid4().hex}"
    token = _FOLDERS.set((*_FOLDERS.get(), folder))
    try:
        yield
    finally:
        _FOLDERS.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and the rows outlive the executors that made them.

    stays: the table outlives the scratch it is written in, but not one around that.
    """
    folders = _FOLDERS.get()[:-1] if stays else _FOLDERS.get()
    path = f"{folders[-1] if folders else shared_dir(df.sparkSession) + '/stillflow'}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, keys: Sequence[Column], values: Sequence[str], name: str) -> DataFrame:
    """df and, for each column of values (whole or double), its sum over all earlier rows in the order of keys, as before_<value>.

    A sum within each partition of a range partitioning, and the sums of the partitions before it: no key is too hot for that.
    """
    ordered = df.repartitionByRange(partitions(df), *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())

    def sums(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {v: 0 for v in values}
        for batch in rows:
            added = []
            for v in values:
                x = batch.column(v).to_numpy(zero_copy_only=False)
                until = np.cumsum(x)
                added.append(pa.array(total[v] + until - x))
                total[v] += until[-1] if len(until) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *(f"_in_{v}" for v in values)])

    schema = widened(ordered.schema, **{f"_in_{v}": df.schema[v].dataType for v in values})
    out = written(ordered.mapInArrow(sums, schema), name)
    # One row for each partition, so as many as the setting says: these may go to the driver.
    parts = sorted(out.groupBy("_part").agg(*(F.sum(v).alias(v) for v in values)).collect(), key=lambda r: r._part)
    for v in values:
        before, until = {}, 0
        for r in parts:
            before[r._part] = until
            until += r[v]
        base = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[F.col("_part")] if before else F.lit(0)
        out = out.withColumn(f"before_{v}", F.col(f"_in_{v}") + base)
    return out.drop("_part", *(f"_in_{v}" for v in values))


def widened(schema: T.StructType, **kinds: T.DataType | str) -> T.StructType:
    """schema and further columns (StructType.add would change the DataFrame's own)."""
    out = T.StructType(list(schema.fields))
    for name, kind in kinds.items():
        out.add(name, kind)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches(rows: Iterable[pa.RecordBatch], column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices with about limit bytes of text each (at least one row, however long its text is)."""
    for batch in rows:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < n:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def held_out(doc_id: str, folds: int, fold: int) -> F.Column:
    """crc32 of doc_id as text, modulo folds, equals fold; a null doc_id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds) == fold
