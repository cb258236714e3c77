"""Extensions: the two append-only logs as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstone.functions.canonical import digest
from quillstone.operators.audit import leakage_incidents
from quillstone.operators.events import envelope_text


def stream_incidents(events: DataFrame, sources: DataFrame, context: DataFrame, allowed_hosts: list[str]) -> DataFrame:
    """Leakage incidents of a stream of audit events; sources and context are tables."""
    return leakage_incidents(events, sources, context, allowed_hosts)


def stream_chain_errors(events: DataFrame) -> DataFrame:
    """investigation_id, sequence, error of a stream of chained events. Each
    investigation's state is its last sequence and hash; rows of one micro-batch
    are taken in order of their sequence."""
    ready = events.withColumn("__hash", digest(envelope_text(F.col("payload")))).select("investigation_id", "sequence", "previous_event_hash", "event_hash", "__hash")

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, head = state.get if state.exists else (0, None)
        out = []
        for row in pd.concat(list(frames)).sort_values("sequence").itertuples(index=False):
            sequence, previous, own, computed = row[1], row[2], row[3], row[4]
            if sequence != last + 1:
                out.append((key[0], sequence, "SEQUENCE"))
            if previous != head:
                out.append((key[0], sequence, "PREVIOUS_HASH"))
            if own != computed:
                out.append((key[0], sequence, "DIGEST"))
            last, head = int(sequence), own
        state.update((last, head))
        yield pd.DataFrame(out, columns=["investigation_id", "sequence", "error"])

    return ready.groupBy("investigation_id").applyInPandasWithState(check, "investigation_id string, sequence long, error string", "last long, head string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time_col: str, by: str, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by tumbling window and ``by``, with a watermark."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
