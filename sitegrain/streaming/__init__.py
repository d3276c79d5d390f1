"""Structured Streaming versions of the operators whose results grow with the input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = (
    "audit_id string, seq bigint, ts timestamp, type string, page struct<site:string,url:string,status:int>, crawled int, queued int, phase string,"
    " done int, total int, message string"
)


def audit_progress(events: DataFrame) -> DataFrame:
    """Running state per audit: latest phase, counters and last page, decided by ``seq`` so late rows do no harm."""
    latest = lambda c, cond=None: F.max_by(c, F.when(F.col(c).isNotNull() if cond is None else cond, F.col("seq")))
    return events.groupBy("audit_id").agg(
        latest("phase").alias("phase"), latest("crawled").alias("crawled"), latest("queued").alias("queued"), F.count_if(F.col("type") == "page").alias("pages"),
        F.max_by("page.url", F.when(F.col("type") == "page", F.col("seq"))).alias("last_page"), F.max(F.col("type") == "done").alias("finished"))


def last_pages(events: DataFrame, n: int = 8) -> DataFrame:
    """The newest n pages per audit; batch or ``foreachBatch``."""
    from sitegrain.operators.ranking import top_n

    return top_n(events.where("type = 'page'"), ["audit_id"], [F.col("seq").desc()], n, "newest")


def _limit_rows(at: list[float], max_requests: int, window: float, state: tuple[int, float] | None) -> tuple[list[tuple[bool, int]], tuple[int, float]]:
    count, reset = state or (0, float("-inf"))
    out = []
    for t in at:
        if reset <= t:
            count, reset = 1, t + window
            out.append((True, 0))
        elif count >= max_requests:
            out.append((False, int(-(-(reset - t) // 1))))
        else:
            count += 1
            out.append((True, 0))
    return out, (count, reset)


LIMIT_SCHEMA = "key string, event_id bigint, ts timestamp, ok boolean, retry_after_sec int"


def fixed_window_limit(requests: DataFrame, max_requests: int, window_seconds: float, order_delay: str = "10 minutes") -> DataFrame:
    """Verdict per request: a window opens at a key's first request and lets ``max_requests`` through. Streaming.

    State per key is two numbers; it is dropped once the watermark passes the end of the window.
    """

    def limit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "event_id"], ignore_index=True)
        at = [t.timestamp() for t in rows["ts"]]
        known = tuple(state.get) if state.exists else None
        verdicts, (count, reset) = _limit_rows(at, max_requests, window_seconds, known)
        state.update((count, reset))
        state.setTimeoutTimestamp(max(int(reset * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"], "ts": rows["ts"], "ok": [v[0] for v in verdicts], "retry_after_sec": [v[1] for v in verdicts]})

    marked = requests.withWatermark("ts", order_delay)
    return marked.groupBy("key").applyInPandasWithState(limit, LIMIT_SCHEMA, "count long, reset double", "append", GroupStateTimeout.EventTimeTimeout)


def _window_map(t: np.ndarray, start: float, window: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How a time slice moves a limiter on: for each possible first opening in the slice, when its last window ends and how many
    requests that window has seen. Only requests in the first window length of the slice can be first openings."""
    n = len(t)
    nxt = np.searchsorted(t, t + window, side="left")
    ends, seen = np.empty(n), np.empty(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        j = nxt[i]
        ends[i], seen[i] = (ends[j], seen[j]) if j < n else (t[i] + window, n - i)
    first = min(n, int(np.searchsorted(t, start + window, side="left")) + 1)
    return t[:first], ends[:first], seen[:first]


def fixed_window_limit_batch(requests: DataFrame, max_requests: int, window_seconds: float, slice_windows: int = 256) -> DataFrame:
    """The same verdicts over a table, with a busy key split into time slices.

    1. Each (key, slice) tells, for every request that could open its first window, the state in which the slice would end.
    2. Slices of a key are chained in time order; this pass sees one window length of requests per slice, not all rows.
    3. Each slice, now knowing the state it starts in, judges its own requests.
    """
    width = window_seconds * slice_windows
    at = F.unix_micros("ts") / F.lit(1e6)
    sliced = requests.select("key", "event_id", "ts", at.alias("t"), F.floor(at / width).alias("slice"))

    def transitions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (key, piece), rows in _groups(frames, ["key", "slice"]):
            opens, ends, seen = _window_map(rows["t"].to_numpy(), piece * width, window_seconds)
            yield pd.DataFrame({"key": key, "slice": piece, "opens": [opens.tolist()], "ends": [ends.tolist()], "seen": [seen.tolist()], "n": len(rows)})

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, reset, count = None, float("-inf"), 0
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.key != key:
                    key, reset, count = row.key, float("-inf"), 0
                out.append((row.key, row.slice, reset, count))
                i = int(np.searchsorted(np.asarray(row.opens), reset, side="left"))
                reset, count = (row.ends[i], row.seen[i]) if i < len(row.opens) else (reset, count + row.n)
            yield pd.DataFrame(out, columns=["key", "slice", "reset", "count"])

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (key, _), rows in _groups(frames, ["key", "slice"]):
            # A window passed on by an earlier slice has let through at most its limit.
            state = (min(int(rows["count"].iloc[0]), max_requests), float(rows["reset"].iloc[0]))
            verdicts, _ = _limit_rows(rows["t"].tolist(), max_requests, window_seconds, state)
            yield rows[["key", "event_id", "ts"]].assign(ok=[v[0] for v in verdicts], retry_after_sec=[v[1] for v in verdicts])

    laid = sliced.repartition("key", "slice").sortWithinPartitions("key", "slice", "t", "event_id")
    moves = laid.select("key", "slice", "t").mapInPandas(transitions, "key string, slice long, opens array<double>, ends array<double>, seen array<long>, n long")
    entered = moves.repartition("key").sortWithinPartitions("key", "slice").mapInPandas(chain, "key string, slice long, reset double, count long")
    joined = sliced.join(entered, ["key", "slice"]).repartition("key", "slice").sortWithinPartitions("key", "slice", "t", "event_id")
    return joined.mapInPandas(judge, LIMIT_SCHEMA)


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of rows that arrive sorted by key; a group may span several batches."""
    held: list[pd.DataFrame] = []
    current = None
    for frame in frames:
        for key, rows in frame.groupby(keys, sort=False):
            if key != current and held:
                yield current, pd.concat(held)
                held = []
            current = key
            held.append(rows)
    if held:
        yield current, pd.concat(held)


def first_lookups(lookups: DataFrame, ttl: str) -> DataFrame:
    """One lookup per key within its lifetime; later ones inside it are dropped. Streaming."""
    return lookups.withWatermark("fetched_at", ttl).dropDuplicatesWithinWatermark(["key"])


def completed_overviews(sections: DataFrame, total: int = 8) -> DataFrame:
    """Domains and how many of their sections have arrived; complete when all have."""
    return sections.groupBy("domain").agg(F.size(F.collect_set("section")).alias("arrived")).withColumn("complete", F.col("arrived") >= total)
