"""The flattening on a stream of new date shards.

C1 is row-local (explode + projections), so the same function runs on a
streaming ``DataFrame`` unchanged: new visit files arriving in the source
folder become flat events in the sink, exactly once as long as a restart
names the same checkpoint folder.
Per-session steps are batch work on the saved flat table (sessions are
given by the visit id; nothing is sessionized on the stream).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from journeykit.operators.flatten import preprocess_hits
from journeykit.sources.visits import VISITS_DDL


def stream_flat_events(spark: SparkSession, source_path: str, sink_path: str,
                       checkpoint_path: str, available_now: bool = True,
                       date_from: str | None = None, date_to: str | None = None) -> StreamingQuery:
    """Start a stream: nested visit Parquet files → flat event Parquet files.

    ``checkpoint_path`` holds the stream's offsets: a durable folder that
    belongs to this one source and sink, and the same one at every restart
    (a new folder would number its batches from 0 again, which the sink has
    already committed and would skip). ``available_now`` processes what is
    there and stops (incremental batch); otherwise the stream keeps running."""
    visits = spark.readStream.schema(VISITS_DDL).parquet(source_path)
    flat = preprocess_hits(visits, date_from, date_to)
    writer = (flat.writeStream.format("parquet")
              .option("path", sink_path)
              .option("checkpointLocation", checkpoint_path)
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
