"""Streaming forms of the store operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.sources.writers import replace_parts


def latest_by_window(events: DataFrame, at: str, state: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """STM-01: for each window and state the number of events and the last time; events later than ``late`` are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), state).agg(F.count("*").alias("n"), F.max(at).alias("last_at"))


def first_seen(rows: DataFrame, at: str, digest: str, within: str = "1 day") -> DataFrame:
    """STM-04: the first row of each hash, as long as the watermark remembers it."""
    return rows.withWatermark(at, within).dropDuplicatesWithinWatermark([digest])


def question_states(events: DataFrame, key: str, at: str, event: str, late: str = "1 hour", most: str | None = None) -> DataFrame:
    """STM-03, SNK-09: the state machine of questions: (key, state, n_rejected), after each batch that has events of the
    key, and when a claim has run out.

    A claim takes a question that is pending or failed; while it is running a claim is rejected, and once it is
    completed a claim changes nothing. complete and fail hold whatever the state. Events of a key are taken in order of
    time, as ``store.question_states`` takes all of them at once. With ``most``, a claim that has run longer than that
    when the watermark passes goes back to pending.

    Needs a state store with timers: spark.sql.streaming.stateStore.providerClass must name RocksDB's.
    """
    from pyspark.sql.streaming import StatefulProcessor

    fields, name = {f.name: f.dataType.simpleString() for f in events.schema.fields}, key
    span = None if most is None else int(pd.Timedelta(most).total_seconds() * 1000)

    class Questions(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.held = handle.getValueState("question", "state string, n_rejected long, until long")

        def out(self, key, state, rejected):
            return pd.DataFrame({name: [key[0]], "state": [state], "n_rejected": [rejected]})

        def handleInputRows(self, key, rows, timerValues):
            state, rejected, until = self.held.get() if self.held.exists() else ("pending", 0, None)
            events_now = pd.concat(list(rows)).sort_values(at, kind="stable")
            for kind, time in zip(events_now[event], events_now[at], strict=True):
                if kind == "claim" and state == "running":
                    rejected += 1
                elif kind == "claim" and state != "completed":
                    state, until = "running", None if span is None else int(time.timestamp() * 1000) + span
                    if until is not None:
                        self.handle.registerTimer(until)
                elif kind in ("complete", "fail"):
                    state, until = "completed" if kind == "complete" else "failed", None
            self.held.update((state, rejected, until))
            yield self.out(key, state, rejected)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            state, rejected, until = self.held.get()
            if state == "running" and until is not None and expiredTimerInfo.getExpiryTimeInMs() >= until:
                self.held.update(("pending", rejected, None))
                yield self.out(key, "pending", rejected)

        def close(self):
            pass

    watched = events.withWatermark(at, late).select(key, at, event).filter(F.col(event).isin("claim", "complete", "fail")).groupBy(key)
    return watched.transformWithStateInPandas(Questions(), f"{key} {fields[key]}, state string, n_rejected long", "update", "EventTime" if span is not None else "None")


def index_documents(stream: DataFrame, path: str, checkpoint: str, by: str = "document_id"):
    """STM-01, STM-05: each batch replaces what its documents had in the index."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: replace_parts(df, path, [by])).trigger(availableNow=True).start()
