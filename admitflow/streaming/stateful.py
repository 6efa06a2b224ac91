"""Incremental embedding with keyed state.

``incremental`` asks the whole store, in every micro-batch, which notes are
done. Here the stream itself knows: a state per note id (``transformWithState``,
RocksDB) holds whether the note was passed on, so a micro-batch costs its own
rows, whatever the store holds. Notes that were embedded before the stream began
are given once, as the initial state.

Each micro-batch is written under its own number and replaces what an attempt
before it left there, so a replayed batch adds nothing. Of several rows of a note
in one micro-batch the one of the latest file wins (by name, then by text), as
there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from admitflow.operators.embedding import token_mean
from admitflow.sources.sinks import _exists
from admitflow.streaming.incremental import NOTE_SCHEMA

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OncePerNote(StatefulProcessor):
    """Passes a note on the first time that its id comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            if part.empty:  # a key of the initial state alone
                continue
            # by place: after a restart the file's column comes under its own name
            for file, text in zip(part.iloc[:, 2], part.iloc[:, 1], strict=True):
                row = (file or "", text is not None, text or "")
                best = row if best is None else max(best, row)
        if best is not None and not self.done.exists():
            self.done.update((True,))
            yield pd.DataFrame({"note_id": [key[0]], "text": [best[2] if best[1] else None]})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.done.update((True,))

    def close(self) -> None:
        pass


def start_stateful(spark: SparkSession, source: str, store: str, token_vectors: DataFrame, checkpoint: str,
                   done: DataFrame | None = None, once: bool = True):
    """Starts the stream; ``done`` (``note_id``) are the notes embedded before it.
    The state store provider is set on the session, as the API asks for it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    notes = (spark.readStream.schema(NOTE_SCHEMA).option("recursiveFileLookup", "true").parquet(source)
             .filter("note_id IS NOT NULL").select("note_id", "text", F.col("_metadata.file_path").alias("_file")))
    first = done.select("note_id").distinct().groupBy("note_id") if done is not None else None
    fresh = notes.groupBy("note_id").transformWithStateInPandas(
        OncePerNote(), outputStructType=NOTE_SCHEMA, outputMode="Append", timeMode="None", initialState=first)

    def write(batch: DataFrame, number: int) -> None:
        vecs = token_mean(batch, token_vectors, "note_id", "text", "token", "vec")
        vecs.write.mode("overwrite").parquet(f"{store}/batch={number}")

    writer = fresh.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def run_stateful(spark: SparkSession, source: str, store: str, token_vectors: DataFrame, checkpoint: str, done: DataFrame | None = None) -> None:
    start_stateful(spark, source, store, token_vectors, checkpoint, done).awaitTermination()


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """``note_id, vec`` of all micro-batches."""
    if not _exists(spark, store):
        raise FileNotFoundError(f"no store in {store}")
    return spark.read.parquet(store).select("note_id", "vec")
