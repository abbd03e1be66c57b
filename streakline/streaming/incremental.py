"""Load each landed file once.

The streaming checkpoint remembers which files have been read, which is the
incremental form of skipping what is already loaded. ``availableNow`` drains
what has landed and stops, so a scheduler can run it daily. A batch that is
replayed after a failure upserts the same keys again and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def load_new_files(
    spark: SparkSession,
    landing: str,
    ddl: str,
    load: Callable[[DataFrame], object],
    checkpoint: str,
    max_files: int | None = None,
) -> StreamingQuery:
    """Run ``load`` on the documents of every file not seen before.

    ``load`` receives parsed documents, for example
    ``lambda docs: jobs.load_boxscores(warehouse, docs)``.
    """
    reader = spark.readStream.schema(ddl)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    query = (
        reader.json(landing)
        .writeStream.foreachBatch(lambda docs, _: load(docs))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
