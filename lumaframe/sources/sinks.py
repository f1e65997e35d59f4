"""Sinks of streams: what is sent is put aside, and takes its place only when the stream has ended well."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lumaframe.errors import InvalidArgument, IoFailed


class Sink(ABC):
    """send() takes the rows of a trigger, again if the trigger is repeated; finish() flushes and publishes; abort() leaves no trace."""

    @abstractmethod
    def send(self, rows: DataFrame, trigger: int) -> None: ...

    @abstractmethod
    def finish(self) -> int:
        """The number of rows published."""

    @abstractmethod
    def abort(self) -> None: ...


class ParquetSink(Sink):
    """Rows of one schema to one Parquet table, parted by trigger. A trigger that is repeated replaces what it wrote before."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, overwrite: bool = False) -> None:
        self.spark, self.path, self.part, self.schema, self.overwrite = spark, path, f"{path.rstrip('/')}.partial", schema, overwrite
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        if self._store.exists(self._path(path)) and not overwrite:
            raise IoFailed(f"{path} exists")

    def send(self, rows: DataFrame, trigger: int) -> None:
        if [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in self.schema]:
            raise InvalidArgument("the kind of rows can't change within a stream")
        rows.write.mode("overwrite").parquet(f"{self.part}/trigger={trigger}")

    def finish(self) -> int:
        if not self._store.exists(self._path(self.part)):
            self.spark.createDataFrame([], self.schema).write.parquet(f"{self.part}/trigger=0")
        n = self.spark.read.schema(self.schema).parquet(f"{self.part}/trigger=*").count()
        if self.overwrite:
            self._store.delete(self._path(self.path), True)
        if not self._store.rename(self._path(self.part), self._path(self.path)):
            raise IoFailed(f"{self.part} can't be renamed")
        return n

    def abort(self) -> None:
        self._store.delete(self._path(self.part), True)


def packets_from(spark: SparkSession, folder: str, schema: StructType, files_a_trigger: int) -> DataFrame:
    """The Parquet files of a folder as a stream, oldest first, no more than so many files at once."""
    if files_a_trigger < 1:
        raise InvalidArgument("a trigger needs a file at least")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def drain(stream: DataFrame, sink: Sink, checkpoint: str) -> int:
    """Sends all that a stream has now to a sink and finishes it; on any error the sink is aborted and the error raised again."""
    query = stream.writeStream.foreachBatch(sink.send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
        return sink.finish()
    except BaseException:
        query.stop()
        sink.abort()
        raise
