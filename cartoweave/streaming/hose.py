"""Streaming forms (T03, T05-T08, T11, T12): the same operators over readStream frames, and a state machine per request."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cartoweave.functions.text import byte_hex, simple_words, trigrams, user_key
from cartoweave.operators.requests import EVENTS, upserted
from cartoweave.operators.trigram_model import bisect, scored
from cartoweave.operators.views import ATTEMPTS
from cartoweave.sources.store import ROWS_PER_BUCKET, BucketStore


def windowed_counts(events: DataFrame, time: str, keys: list[str], length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling or sliding windows of event time; rows later than ``late`` are dropped when streaming."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def session_counts(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Counts by sessions that end after a pause of ``gap``."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def scored_stream(lines: DataFrame, model: DataFrame, default: float, keys: tuple[str, ...] = ("screen_name",), time: str | None = None, mode: str = "word_aware_lc", late: str = "10 minutes") -> DataFrame:
    """(keys, time, score) of each line; ``model`` is static evidence (tg, evidence), ``keys`` tell the lines apart.

    A stream-static join on the trigrams and one mean per line. With the event time ``time`` the state of a line is dropped
    ``late`` after it; without it (batches, complete mode) nothing is dropped.
    """
    if time:
        lines, keys = lines.withWatermark(time, late), (*keys, time)
    each = lines.select(*keys, F.explode_outer(trigrams("text", mode)).alias("t")).withColumn("tg", byte_hex("t"))
    gain = F.when(F.col("tg").isNotNull(), F.coalesce("evidence", F.lit(default)))
    return each.join(model, "tg", "left").groupBy(*keys).agg(F.coalesce(F.avg(gain), F.lit(0.0)).alias("score"))


def split_sink(model: DataFrame, other: DataFrame | None, threshold: float, good: str, rejected: str, mode: str = "word_aware_lc") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that scores a batch and writes both sides; a repeated batch overwrites its own folder."""

    def run(batch: DataFrame, epoch: int) -> None:
        keyed = batch.withColumn("row", F.monotonically_increasing_id()).persist()
        both = scored(keyed, ["row", "screen_name", "text"], "text", model, other, mode).drop("row").persist()
        for part, path in zip(bisect(both, threshold), (good, rejected), strict=True):
            part.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        both.unpersist()
        keyed.unpersist()

    return run


def user_running_means(scores: DataFrame) -> DataFrame:
    """Running count and mean score of every user (complete or update mode)."""
    return scores.groupBy("screen_name").agg(F.count("*").alias("tweets"), F.avg("score").alias("mean_score"))


def running_token_counts(tweets: DataFrame, user: str, text: str) -> DataFrame:
    """(user, token) counts that grow with the stream."""
    each = tweets.select(user_key(user).alias("user"), F.explode(simple_words(F.lower(text))).alias("token"))
    return each.groupBy("user", "token").agg(F.count("*").alias("count"))


def upsert_sink(path: str, key: str, time: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the latest row of every key in a ``BucketStore`` under ``path``.

    An epoch rewrites only the partitions that hold a key of its batch. A repeated epoch changes nothing: its version is
    there already.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        store = BucketStore(batch.sparkSession, path, (key,), rows_per_bucket)
        if store.version() <= epoch:
            store.merged(batch, lambda stored, arrived: upserted(batch.limit(0) if stored is None else stored, arrived, key, time))

    return run


STATE = "attempts long, started timestamp, completed timestamp"
CHANGE = "request_id string, attempts long, state string"


def request_machine(events: DataFrame) -> DataFrame:
    """(request_id, attempts, state) after each batch of events (request_id, event, ts) for every request it touches."""

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, started, completed = state.get if state.exists else (0, None, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "event"], kind="stable")
        for event, ts in zip(rows["event"], rows["ts"], strict=True):
            if event == "started":
                started = ts.to_pydatetime()
            elif event == "completed":
                completed = min(completed, ts.to_pydatetime()) if completed is not None else ts.to_pydatetime()
            elif event == "failed":
                attempts, started = attempts + 1, None
        state.update((attempts, started, completed))
        name = "completed" if completed is not None else "dead" if attempts >= ATTEMPTS else "underway" if started is not None else "queued"
        yield pd.DataFrame({"request_id": [key[0]], "attempts": [attempts], "state": [name]})

    known = events.where(F.col("event").isin(*EVENTS) & F.col("request_id").isNotNull() & F.col("ts").isNotNull())
    return known.groupBy("request_id").applyInPandasWithState(step, CHANGE, STATE, "update", GroupStateTimeout.NoTimeout)
