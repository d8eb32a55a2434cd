"""Streams with state of their own per key: keys seen before, and timers that fire while nothing arrives.

Both fold the rows of each Arrow batch to one per key before the shuffle, so a key that has a third of all rows sends few
of them. State is one small row per key. Where keys are many, run with the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``), which keeps state on disk and stores only what a batch changed.

Keys may be integers, strings, dates or booleans; a null key is a key like any other.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postlens.streaming.jobs import start_table

KEY = "_key"


def _packed(keys: list[str]):
    """Keys as one string, since pandas would turn integers beside nulls into doubles."""
    return F.to_json(F.struct(*keys)).alias(KEY)


def _unpacked(df: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Keys as columns again. The generator makes rows of the kind that a Pandas UDF takes; the state operator's are not."""
    rest = [c for c in df.columns if c != KEY]
    packed = F.struct(F.from_json(KEY, source.select(*keys).schema).alias(KEY), *rest)
    row = F.col("_row")
    return df.select(F.explode(F.array(packed)).alias("_row")).select(*[row[KEY][k].alias(k) for k in keys], *[row[c].alias(c) for c in rest])


def _newest_of_batch(order: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The row of each key that comes first: known keys before others, then newest, nulls oldest, then least text."""
    by = [("_known", "descending"), *[(c, "descending") for c in order], ("_text", "ascending")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranked = pa.Table.from_batches([batch]).sort_by(by)
            placed = ranked.append_column("_place", pa.array(range(ranked.num_rows), pa.int64()))
            first = placed.group_by(KEY, use_threads=False).aggregate([("_place", "min")])
            yield from ranked.take(first["_place_min"]).to_batches()

    return fold


def unseen_texts(
    jobs: DataFrame, keys: list[str], order: list[str], text: str, known: DataFrame | None = None, forget_after: int | None = None
) -> DataFrame:
    """(keys, text) of every key that no earlier batch had: the newest version of it that its first batch holds.

    Versions are compared by the columns ``order``, nulls oldest, equal ones by least text. ``known`` is a stream with the
    keys, such as the table of what other jobs have embedded; a key that comes in it before or along with its job is not
    returned. ``forget_after`` milliseconds without a row of a key its state goes, and the key counts as new again; by
    default keys are remembered for good. What a batch costs depends on the batch and not on what was stored before.
    """
    rows = jobs.select(_packed(keys), *order, F.col(text).alias("_text"), F.lit(False).alias("_known"))
    if known is not None:
        types = {f.name: f.dataType for f in rows.schema.fields}
        blank = [F.lit(None).cast(types[c]).alias(c) for c in [*order, "_text"]]
        rows = rows.unionByName(known.select(_packed(keys), *blank, F.lit(True).alias("_known")))
    folded = rows.mapInArrow(_newest_of_batch(order), rows.schema)
    by, ascending = ["_known", *order, "_text"], [False] * (1 + len(order)) + [True]

    def first(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, best = state.exists, None
        for frame in frames:
            if not seen:
                if best is not None or len(frame) > 1:  # one row needs no sorting, which would take most of the time of a key
                    frame = pd.concat([best, frame]).sort_values(by, ascending=ascending, na_position="last").iloc[:1]
                best = frame
        state.update((True,))
        if forget_after is not None:
            state.setTimeoutDuration(forget_after)
        if not seen and not best["_known"].iloc[0]:
            yield pd.DataFrame({KEY: [key[0]], text: [best["_text"].iloc[0]]})

    timeout = GroupStateTimeout.NoTimeout if forget_after is None else GroupStateTimeout.ProcessingTimeTimeout
    found = folded.groupBy(KEY).applyInPandasWithState(first, f"{KEY} string, `{text}` string", "seen boolean", "append", timeout)
    return _unpacked(found, jobs, keys)


def stream_embed_unseen(
    jobs: DataFrame,
    keys: list[str],
    order: list[str],
    text: str,
    embed_fn: Callable[[DataFrame, str, str], DataFrame],
    model_name: str,
    target: str,
    checkpoint: str,
    known: DataFrame | None = None,
    trigger: str | None = None,
) -> StreamingQuery:
    """Append (keys, model_name, embedding, created_at) of keys not seen before to ``target``, which is never read.

    The file sink takes each batch once, also when it is repeated. A null text is embedded as an empty one.
    """
    texts = unseen_texts(jobs, keys, order, text, known).withColumn(text, F.coalesce(text, F.lit("")))
    embedded = embed_fn(texts, text, "embedding").select(
        *keys, F.lit(model_name).alias("model_name"), F.col("embedding").cast("array<float>").alias("embedding"), F.current_timestamp().alias("created_at")
    )
    return start_table(embedded, target, checkpoint, trigger)


def _last_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Latest time and number of rows of each key."""
    for batch in batches:
        folded = pa.Table.from_batches([batch]).group_by(KEY, use_threads=False).aggregate([("_last", "max"), ("_n", "sum")])
        yield from folded.select([KEY, "_last_max", "_n_sum"]).rename_columns([KEY, "_last", "_n"]).to_batches()


def silence_timers(events: DataFrame, keys: list[str], ts: str, longer_than: int) -> DataFrame:
    """(keys, silent_from, alert_at, n) of keys from which nothing has arrived for ``longer_than`` milliseconds.

    A timer per key runs in processing time from its last arrival, so an alert comes while all is silent, without any later
    event. ``silent_from`` is the latest time among the key's ``n`` events since its last alert, null if none had a time;
    ``alert_at`` is the time of the batch that fired. A key that speaks again starts anew. Needs a running trigger: with
    ``availableNow`` the stream ends before timers are due.
    """
    rows = events.select(_packed(keys), F.unix_micros(F.col(ts).cast("timestamp")).alias("_last"), F.lit(1).cast("long").alias("_n"))
    folded = rows.mapInArrow(_last_of_batch, rows.schema)

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            now = state.getCurrentProcessingTimeMs() * 1000
            state.remove()
            yield pd.DataFrame({KEY: [key[0]], "_last": pd.array([last], "Int64"), "_now": [now], "n": [n]})
            return
        for frame in frames:
            times = frame["_last"].dropna()
            if len(times):
                last = int(times.max()) if last is None else max(last, int(times.max()))
            n += int(frame["_n"].sum())
        state.update((last, n))
        state.setTimeoutDuration(longer_than)

    fired = folded.groupBy(KEY).applyInPandasWithState(
        watch, f"{KEY} string, _last long, _now long, n long", "last long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
    shown = fired.select(KEY, F.timestamp_micros("_last").alias("silent_from"), F.timestamp_micros("_now").alias("alert_at"), "n")
    return _unpacked(shown, events, keys)


def stop_when_silent(running: StreamingQuery, seconds: float) -> None:
    """Stop a stream of silence alerts once every key has had its alert; an error after so many seconds, or if it failed."""
    end = time.monotonic() + seconds
    try:
        while True:
            done = running.lastProgress
            if done and done["batchId"] > 0 and done["stateOperators"] and done["stateOperators"][0]["numRowsTotal"] == 0:
                return
            if not running.isActive or time.monotonic() > end:
                raise running.exception() or TimeoutError(f"keys without alert after {seconds} seconds")
            time.sleep(0.2)
    finally:
        running.stop()
