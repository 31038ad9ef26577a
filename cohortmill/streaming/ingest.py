"""The bulk import as a stream of NDJSON files: every micro-batch goes through the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..schemas import RECORD
from ..sources.ingest import import_run
from ..storage import Store


def import_stream(spark: SparkSession, source: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Import the files that arrive below ``source`` into the stored tables.

    A batch that runs again after a failure adds nothing twice: subjects get the same ids, and
    evidence that is there is left out.
    """

    def one(batch: DataFrame, number: int) -> None:
        done = import_run(store, batch, f"stream-{number}")
        if done["status"] != "import_success":
            raise RuntimeError(done["error"])

    stream = spark.readStream.schema(RECORD).option("recursiveFileLookup", True).json(source)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
