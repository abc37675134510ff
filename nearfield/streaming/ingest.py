"""A stream of rows into stored signatures.

Signing a row needs no other row, so the stream keeps no state; the bin cap and pruning
are taken at query time over all that is stored. Each micro-batch is written to a
folder of its number, so that a repeated batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(stream: DataFrame, model, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that signs the rows (id, features, values) of ``stream`` with the
    parameters of ``model`` and stores both under ``path``."""

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.select("id", "features", "values").persist()
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        model._sign(rows).write.mode("overwrite").parquet(f"{path}/signatures/batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stored(spark: SparkSession, model, path: str):
    """``model`` over everything stored so far; an id that arrived twice counts once,
    as it was in the latest batch."""
    last = lambda d: d.groupBy("id").agg(F.max_by(F.struct(*[c for c in d.columns if c not in ("id", "batch")]), "batch").alias("r")).select("id", "r.*")
    model.rows, model.signed = last(spark.read.parquet(f"{path}/rows")), last(spark.read.parquet(f"{path}/signatures"))
    model._index = None
    return model
