"""Streams: intake of mail files, and hash chains that grow."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql import functions as F

from letterlens.sources.mail import admitted

FILES = "path string, modificationTime timestamp, length long, content binary"
#: Rows of a case that are given out at a time.
BLOCK = 10_000
CHAIN = "case_id string, event_sequence long, previous_event_hash string, event_hash string"


def read_mail_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """S3: new files as they come, admitted as a batch scan admits them."""
    return admitted(spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(path))


def run_intake(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs the batch job over every batch of new files; the checkpoint keeps a file from being taken twice."""
    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ChainAppender(StatefulProcessor):
    """A5: per case the last sequence and hash; each event is linked to the one before. Events: place, head of its JSON.

    Kept between batches are a number and a digest per case. Within a micro-batch the events of a case are put in order of
    place, so a task holds what the source's limit per trigger lets in, and gives it out in blocks.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "sequence long, hash string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Takes up the chain where a stored one ends."""
        self.state.update((int(initialState["sequence"].iloc[0]), initialState["hash"].iloc[0]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = sorted(e for batch in rows for e in zip(batch["place"], batch["head"], strict=True))
        n, last = self.state.get() if self.state.exists() else (0, None)
        for at in range(0, len(events), BLOCK):
            out = []
            for _, head in events[at:at + BLOCK]:
                n += 1
                text = head.replace('"event_sequence":0', f'"event_sequence":{n}', 1) + json.dumps(last) + "}"
                digest = hashlib.sha256(text.encode()).hexdigest()
                out.append((key[0], n, last, digest))
                last = digest
            yield pd.DataFrame(out, columns=["case_id", "event_sequence", "previous_event_hash", "event_hash"])
        self.state.update((n, last))

    def close(self) -> None:
        pass


def append_chain(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """A stream of events (as for audit.build_chain, place a sortable string) linked per case, across batches.

    `stored` is a chain that a batch job built (case_id, event_sequence, event_hash): a new query goes on from its last
    events; a query restarted from its checkpoint has its own state and passes over it. Cases without events to come cost
    a state each. A case's events have to come in order of place from batch to batch.
    """
    from letterlens.operators.audit import event_json

    head = F.regexp_replace(event_json(F.col("metadata"), F.lit(None).cast("string")), r"null\}$", "")
    rows = events.withColumn("event_sequence", F.lit(0)).select("case_id", F.coalesce(F.col("place"), F.lit("")).alias("place"), head.alias("head"))
    last = None
    if stored is not None:
        last = stored.where("case_id is not null and event_hash is not null").groupBy("case_id").agg(
            F.max("event_sequence").cast("long").alias("sequence"), F.max_by("event_hash", "event_sequence").alias("hash")).groupBy("case_id")
    return rows.groupBy("case_id").transformWithStateInPandas(ChainAppender(), outputStructType=CHAIN, outputMode="Append", timeMode="None", initialState=last)
