"""The latest record of each key, kept by a stream in a versioned dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mapweave.sources.versions import VersionedTable


def keep_state(changes: DataFrame, table: VersionedTable, at: list[str], checkpoint: str) -> StreamingQuery:
    """Upsert all changes not seen before, then stop; a version for each micro-batch.

    Changes may come late and in any order, and a batch that is run again after
    a failure changes nothing, since an upsert takes the greatest by ``at``.
    """
    return (changes.writeStream.foreachBatch(lambda batch, _: table.upsert(batch, at))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
