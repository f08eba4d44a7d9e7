"""Continuous folder ingest: new files become registry rows, each once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mapweave.sources.files import registry_rows


def register_folder(spark: SparkSession, folder: str, registry: str, checkpoint: str, client: str, batch: str,
                    files_per_batch: int = 1000) -> StreamingQuery:
    """Append the registry rows of all files not seen before, then stop.

    The file source and the checkpoint keep track of what was registered, so
    running it again only adds new files.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = (spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)
             .withColumn("name", F.element_at(F.split("path", "/"), -1))
             .where(~F.lower("name").endswith(".json")))
    return (registry_rows(files, F.lit(client), F.lit(batch)).writeStream.format("parquet")
            .option("path", registry).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())
