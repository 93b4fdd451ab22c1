"""Tables that a job writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from docketmill.ship import shared_folder


def written(frame: DataFrame) -> DataFrame:
    """A frame written out and read back: its lineage ends there, and a lost executor costs only its own tasks."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/docketmill-tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Removes the files of frames from written() that no later plan reads."""
    for frame in frames:
        for file in frame.inputFiles()[:1]:
            context = frame.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(file.rpartition("/")[0])
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
