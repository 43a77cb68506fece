"""Structured Streaming over the observation log."""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.names import canonical_path, instant_ms, label
from ..session import shared_checkpoints

#: Fixed values of decaying attention: gain of a read, more of one after an edit, loss a tick, least weight kept.
READ_GAIN, EDITED_GAIN, DECAY, LEAST = 0.1, 0.3, 0.05, 0.01
#: Days that state of attention is kept without events.
KEEP_DAYS = 30


def observation_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """The observation log as a stream, with ``event_time`` and names in one form.

    ``path`` is a Parquet file or folder; as a pattern (its last letter in brackets) it may be either.
    """
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.select(
        "id", "session_id", instant_ms(F.col("timestamp")).alias("instant"), label(F.col("event")).alias("event"), canonical_path(F.col("file_path")).alias("file_path")
    ).withColumn("event_time", F.timestamp_millis("instant"))


def hourly_counts(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Observations per hour and event, each ``id`` once; those later than ``late`` are dropped with their state."""
    fresh = stream.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["id"])
    counted = fresh.groupBy(F.window("event_time", "1 hour").alias("w"), "event").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("hour"), "event", "n")


def attention_weights(stream: DataFrame) -> DataFrame:
    """``(session_id, file_path, weight, accesses, edited)`` with state per session and file, each ``id`` once.

    A read adds ``READ_GAIN`` (``EDITED_GAIN`` more once the file was edited), up to 1; each
    event of the file between loses nothing, each full minute since its last event loses
    ``DECAY``; a weight of ``LEAST`` or less starts anew. Events count in the order of their
    time, then ``id``, in whatever order and batches they arrive: state is what the events before
    the watermark came to, and the later ones as they are. A file is let go when the watermark,
    ``KEEP_DAYS`` behind the latest event, is as long past its last one. The state of all files of
    a session is kept together, so that Python is called once a session and batch, not once a file.
    """

    def folded(came: tuple, events: Iterator[tuple]) -> tuple:
        weight, accesses, edited, last = came
        for at, _, event in events:
            if accesses and at > last:
                weight -= DECAY * ((at - last) // 60_000)
            weight = 0.0 if weight <= LEAST else weight
            edited = edited or event in ("file:edit", "file:create")
            if event == "file:read":
                weight = min(1.0, weight + READ_GAIN + (EDITED_GAIN if edited else 0.0))
            accesses, last = accesses + 1, max(last, at)
        return float(weight), int(accesses), bool(edited), int(last)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        files = json.loads(state.get[0]) if state.exists else {}
        fresh = defaultdict(list)
        for batch in batches:
            for file, at, i, event in zip(*(batch[c].tolist() for c in ("file_path", "instant", "id", "event"))):
                fresh[file].append((int(at), int(i), None if pd.isna(event) else event))
        files = {file: kept for file, kept in files.items() if file in fresh or kept[-1] >= mark}
        found = []
        for file, events in fresh.items():
            *came, held, _ = files.get(file, (0.0, 0, False, 0, [], 0))
            events = sorted([*(tuple(e) for e in held), *events], key=lambda e: e[:2])
            came = folded(came, (e for e in events if e[0] < mark))
            held = [e for e in events if e[0] >= mark]
            weight, accesses, edited, last = folded(came, held)
            files[file] = (*came, held, max(last, mark) + KEEP_DAYS * 86_400_000)
            found.append((key[0], file, round(weight, 6), accesses, edited))
        if files:
            state.update((json.dumps(files),))
            state.setTimeoutTimestamp(max(min(kept[-1] for kept in files.values()), mark + 1))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=["session_id", "file_path", "weight", "accesses", "edited"])

    return (
        stream.withWatermark("event_time", f"{KEEP_DAYS} days")
        .where("id is not null and session_id is not null and file_path is not null and instant is not null")
        .dropDuplicatesWithinWatermark(["id"])
        .select("session_id", "file_path", "instant", "id", "event", "event_time")
        .groupBy("session_id")
        .applyInPandasWithState(fold, "session_id string, file_path string, weight double, accesses long, edited boolean", "files string", "update", GroupStateTimeout.EventTimeTimeout)
    )


def run_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream over what is there, and give the latest row of every key.

    Updates of each micro-batch are written under its number beside the checkpoints, in the
    folder all executors share, so a batch that is run again replaces itself.
    """
    spark = stream.sparkSession
    shared_checkpoints(spark)
    out = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/updates/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    updates = spark.read.schema(schema).parquet(f"{out}/updates")
    rest = [c for c in stream.columns if c not in keys]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*keys, *(f"r.{c}" for c in rest))
