"""Tables written one folder per micro-batch, and keyed state merged in spans of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery


class BatchStore:
    """Append-only tables below ``folder``; each micro-batch owns the partition ``batch=<id>`` of a table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def write(self, table: str, batch: int, df: DataFrame) -> DataFrame:
        """Write this batch's rows and return them as read back from the store."""
        path = f"{self._path(table)}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, table: str, schema, before: int | None = None) -> DataFrame:
        """Rows of all batches, or of those before one; partition pruning skips the others."""
        path = self._path(table)
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        columns = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        layout = T.StructType([*columns.fields, T.StructField("batch", T.LongType())])
        rows = self.spark.read.schema(layout).option("basePath", path).parquet(path)
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        return rows.drop("batch")

    def done(self, path: str) -> bool:
        """Whether a folder was written to its end."""
        return self._exists(f"{path}/_SUCCESS")

    def remove(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


GONE, BATCH, BUCKET = "__gone", "__batch", "__bucket"


class KeyedLog:
    """The newest row of each key, kept as spans of micro-batches.

    A micro-batch writes only the rows that it changes, as the span of its own number. The batch that completes a
    block of ``width ** t`` batches merges the block's spans into one. So a lookup meets at most ``width - 1`` spans
    a level, a row is rewritten once a level (the logarithm of the number of batches, and never by each batch), and
    merged spans have a folder for each of the ``buckets`` that ``bucket_by`` deals keys to: a lookup opens only the
    folders of its own keys. Which spans make up a state follows from the batch number, without listing folders.

    A row marked as gone hides the older rows of its key; a merge from batch 0 on drops it. Rows whose ``expires``
    column lies below the horizon of a read or a merge are left out. ``version`` orders rows ahead of their batch.
    ``base`` holds rows older than all batches. A batch that is repeated after a failure reads the same spans and
    overwrites its own; spans that a merge has replaced go when the batch after the merge writes, and with them the
    states before the last batch.
    """

    def __init__(
        self, store: BatchStore, table: str, schema: str, keys: list[str], bucket_by: list[str] | None = None,
        version: str | None = None, expires: str | None = None, base: DataFrame | None = None, width: int = 8, buckets: int = 64,
    ):
        self.store, self.spark, self.keys, self.bucket_by = store, store.spark, keys, bucket_by or keys
        self.schema, self.version, self.expires, self.base = T.StructType.fromDDL(schema), version, expires, base
        self.folder, self.width, self.buckets = f"{store.folder}/{table}", width, buckets
        self.layout = T.StructType([
            *self.schema.fields, T.StructField(GONE, T.BooleanType()), T.StructField(BATCH, T.LongType()), T.StructField(BUCKET, T.IntegerType()),
        ])

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def _span(self, start: int, end: int) -> str:
        return f"{self.folder}/span={start}-{end}"

    def spans(self, start: int, end: int) -> list[str]:
        """The folders that make up the batches from ``start`` to before ``end``: the longest spans that are complete."""
        size = 1
        while start % (size * self.width) == 0 and start + size * self.width <= end:
            size *= self.width
        found, at = [], start
        while at < end:
            while size > 1 and (at + size > end or not self.store.done(self._span(at, at + size))):
                size //= self.width
            if self.store.done(self._span(at, at + size)):
                found.append(self._span(at, at + size))
            at += size
            while at % (size * self.width) == 0 and at + size * self.width <= end:
                size *= self.width
        return found

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that some rows fall into: at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())

    def _rows(self, paths: list[str], touched: list[int] | None, horizon: int | None) -> DataFrame:
        parts = [self.spark.read.schema(self.layout).parquet(path) for path in paths]
        rows = parts[0] if parts else self.spark.createDataFrame([], self.layout)
        for part in parts[1:]:
            rows = rows.unionByName(part)
        if touched is not None:
            rows = rows.filter(F.col(BUCKET).isin(touched))
        return rows if horizon is None else rows.filter(F.col(self.expires) >= horizon)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.layout.names if c not in self.keys]
        order = F.struct(*([self.version] if self.version else []), BATCH)
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), order).alias("__row")).select(
            *[F.col(c) if c in self.keys else F.col(f"__row.{c}").alias(c) for c in self.layout.names])

    def read(self, before: int = 1 << 40, touched: list[int] | None = None, horizon: int | None = None) -> DataFrame:
        """The newest rows as of the start of batch ``before``; ``touched`` limits them to some buckets."""
        if before == 1 << 40:
            before = self._end()
        rows = self._rows(self.spans(0, before), touched, horizon)
        if self.base is not None:
            base = self.base.select(*self.schema.names).withColumns({GONE: F.lit(False), BATCH: F.lit(-1).cast("long"), BUCKET: self._bucket()})
            rows = rows.unionByName(base if touched is None else base.filter(F.col(BUCKET).isin(touched)))
        return self._newest(rows).filter(~F.col(GONE)).select(*self.schema.names)

    def _end(self) -> int:
        """One more than the last batch, from the folder names; only reads from outside the stream need it."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(root)] if files.exists(root) else []
        return max((int(n.rpartition("-")[2]) for n in names if n.startswith("span=")), default=0)

    def write(self, batch: int, rows: DataFrame, gone: Column | None = None, horizon: int | None = None) -> DataFrame:
        """Write the rows that a batch changes and merge the blocks that it completes; gives the rows back."""
        self._drop_replaced(batch)
        path = self._span(batch, batch + 1)
        rows.withColumns({GONE: F.lit(False) if gone is None else F.coalesce(gone, F.lit(False)), BATCH: F.lit(batch).cast("long"), BUCKET: self._bucket()}).select(
            *self.layout.names).write.mode("overwrite").parquet(path)
        size = self.width
        while (batch + 1) % size == 0:
            start, step = batch + 1 - size, size // self.width
            merged = self._newest(self._rows(
                [p for at in range(start, batch + 1, step) for p in self.spans(at, at + step)], None, horizon))
            if start == 0:
                merged = merged.filter(~F.col(GONE))
            merged.repartition(self.buckets, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(self._span(start, batch + 1))
            size *= self.width
        return self.spark.read.schema(self.layout).parquet(path).select(*self.schema.names)

    def _drop_replaced(self, batch: int) -> None:
        size = self.width
        while batch and batch % size == 0:
            step = size // self.width
            if self.store.done(self._span(batch - size, batch)):
                for at in range(batch - size, batch, step):
                    self.store.remove(self._span(at, at + step))
            size *= self.width


def run(
    stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True,
    mode: str = "append",
) -> StreamingQuery:
    """Start ``step`` on every micro-batch; ``available_now`` drains the input and stops."""
    writer = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
