"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketmill.ship import shared_folder, ship

#: Rows turned into Python objects at a time, so that a large Arrow batch is never doubled.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns are never carried along. Workers get the package first."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *columns)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/docketmill/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Removes all that cut() wrote for this application, once every result that reads it has been written out."""
    _delete(spark, _own_folder(spark))
    _made.pop(spark.sparkContext.applicationId, None)


#: Paths that cut() wrote, by application, in order.
_made: dict[str, list[str]] = {}


def cut(frame: DataFrame) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    spark = frame.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(frame.schema).parquet(path)


def cut_alone(spark: SparkSession, make: Callable[[], DataFrame], *before: DataFrame) -> DataFrame:
    """cut() of what `make` returns; all that was cut on the way there is removed, and so are the frames of `before`."""
    made = _made.setdefault(spark.sparkContext.applicationId, [])
    start = len(made)
    out = cut(make())
    for path in made[start:-1]:
        _delete(spark, path)
    del made[start:-1]
    drop(*before)
    return out


def drop(*frames: DataFrame) -> None:
    """Removes the files behind frames that cut() made and that no later plan reads."""
    for frame in frames:
        for file in frame.inputFiles()[:1]:
            _delete(frame.sparkSession, file.rpartition("/")[0])


def remainder(column: str, divisor: int) -> Column:
    """crc32 of a key as text, modulo divisor; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ROWS_AT_ONCE rows; nothing is copied."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def small(frame: DataFrame, most: int) -> DataFrame:
    """A broadcast hint where the frame has at most `most` rows; else the frame as it is, joined by shuffle."""
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame
