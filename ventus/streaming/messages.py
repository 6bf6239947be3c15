"""Messages as a stream: each id once, and state by conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventus.operators.conversation import is_reset
from ventus.sources.tables import shared_folder

#: How long a repeated delivery of a message is known for one.
HORIZON = "1 day"
HISTORY = 12

OUTPUT = "conversation string, n_messages long, unread long, last_message string, mode string"
STATE = "n_messages long, unread long, last_message string, mode string"


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need timestamps with a zone; tables have them without."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def each_once(messages: DataFrame, key: str = "msg_id", time: str = "ts", horizon: str = HORIZON) -> DataFrame:
    """Drops repeated deliveries that come within the horizon."""
    return timed(messages, time).withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def _advance(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    n, unread, last, mode = state.get if state.exists else (0, 0, "", "agent")
    for batch in batches:
        for row in batch.sort_values("ts").itertuples(index=False):
            n, last = n + 1, row.content
            if row.role == "user":
                unread += 1
            elif row.role == "human":
                unread, mode = 0, "human"
            else:
                unread, mode = 0, mode
    state.update((n, unread, last, mode))
    yield pd.DataFrame([(key[0], n, unread, last, mode)], columns=["conversation", "n_messages", "unread", "last_message", "mode"])


def conversation_state(messages: DataFrame) -> DataFrame:
    """Messages, unread count, last message and mode of each conversation, updated by micro-batch.

    messages: conversation, role, content, ts.
    """
    return messages.groupBy("conversation").applyInPandasWithState(_advance, OUTPUT, STATE, "update", "NoTimeout")


def _remember(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    roles, texts = (list(x) for x in state.get) if state.exists else ([], [])
    for batch in batches:
        for row in batch.sort_values("ts").itertuples(index=False):
            if row.reset:
                roles, texts = [], []
            else:
                roles, texts = [*roles, row.role][-HISTORY:], [*texts, row.content][-HISTORY:]
    state.update((roles, texts))
    yield pd.DataFrame({"conversation": [key[0]], "roles": [roles], "texts": [texts]})


def history_state(messages: DataFrame) -> DataFrame:
    """The last HISTORY messages of each conversation since the user's last reset, updated by micro-batch.

    messages: conversation, role, content, ts.
    """
    reset = (F.col("role") == "user") & is_reset("content")
    rows = messages.withColumn("reset", F.coalesce(reset, F.lit(False)))
    kept = "roles array<string>, texts array<string>"
    return rows.groupBy("conversation").applyInPandasWithState(_remember, f"conversation string, {kept}", kept, "update", "NoTimeout")


def to_answer(states: DataFrame) -> DataFrame:
    """Conversations that the agent answers; a person has taken over the others."""
    return states.where("mode <> 'human' and unread > 0")


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream, into a table in a new shared folder, under a name; a batch that runs again replaces its rows."""
    path = f"{shared_folder(stream.sparkSession)}/{name}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    rows = stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)
    rows.createOrReplaceTempView(name)
    return rows


def outbox(replies: DataFrame, path: str, checkpoint: str, most_chars: int = 4096):
    """Writes replies, cut to what a message holds, to a table that a sender reads, by epoch.

    A batch that runs again, as after a loss, takes the place of its first run, so no reply is there twice.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("reply", F.substring("reply", 1, most_chars)).write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")

    return replies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


BURST = "conversation string, first timestamp, last timestamp, n_messages long, text string"
_PENDING = "first timestamp, last timestamp, texts array<string>"


def _gather(wait: pd.Timedelta):
    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, last, texts = state.get if state.exists else (None, None, [])
        first, last, texts = (first and pd.Timestamp(first)), (last and pd.Timestamp(last)), list(texts)
        out = []

        def done():
            out.append((key[0], first, last, len(texts), "\n".join(texts)))

        if state.hasTimedOut:
            done()
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "content"], kind="stable")
            for ts, content in zip(rows.ts, rows.content, strict=True):
                if texts and ts - last > wait:
                    done()
                    texts = []
                first, last = (ts, ts) if not texts else (first, max(last, ts))
                texts.append(content or "")
            state.update((first.to_pydatetime(), last.to_pydatetime(), texts))
            due = last.tz_localize("UTC") if last.tzinfo is None else last
            due = int((due + wait).timestamp() * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["conversation", "first", "last", "n_messages", "text"])

    return run


def bursts(messages: DataFrame, wait: str = "5 seconds", late: str = "0 seconds") -> DataFrame:
    """What users write in one go, as one message to answer: once nothing has come from a conversation for a time.

    messages: conversation, content, ts.  Each conversation holds what it waits
    with as state, and a timer in event time, set anew with each message, gives it out; late is how
    far messages may come out of order.  What the watermark hasn't passed yet waits.
    """
    rows = timed(messages).withWatermark("ts", late)
    return rows.groupBy("conversation").applyInPandasWithState(_gather(pd.Timedelta(wait)), BURST, _PENDING, "append", "EventTimeTimeout")
