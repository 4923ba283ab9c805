"""ST2-ST4 as keyed state that outlives restarts.

``first_in_event_order`` holds rows back until the watermark has passed them and then takes them in the order of time, so the
outcome doesn't depend on how rows were cut into batches. ``first_wins_stream`` is G1 per key on a stream: the
last accepted titles and the accepted links are state.

Both need a state store that keeps lists and maps (``use_state_store``). A key's state is one number and its waiting rows, or
``horizon`` titles and a map of links; links leave after their time to live, if there is one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitrine import fixed_values as fv
from vitrine.functions.similarity import RecentTitles
from vitrine.functions.text import normalize_title
from vitrine.functions.urls import normalize_link
from vitrine.operators.greedy import ACCEPTED, SAME_LINK, SIMILAR


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _plain(value):
    """A pandas cell as the value that a state row takes."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value.item() if hasattr(value, "item") else value


def _rows(frame: pd.DataFrame) -> list[tuple]:
    return [tuple(map(_plain, row)) for row in frame.itertuples(index=False, name=None)]


class _EventOrder(StatefulProcessor):
    """Rows wait until the watermark has passed their time; then the time to live decides in order of time."""

    def __init__(self, schema: T.StructType, key: str, at: str, order: Sequence[str], ttl_seconds: int):
        self.schema, self.key = schema, key
        names = schema.fieldNames()
        self.at, self.order, self.ttl = names.index(at), [names.index(c) for c in order], ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.accepted = handle.getValueState("accepted", "at long")

    def _micros(self, row: tuple) -> int:
        return pd.Timestamp(row[self.at]).value // 1000

    def _wake(self, rows: list[tuple], watermark: int) -> None:
        """One timer, for the first of the rows: when it rings, the next one is set for what still waits."""
        self.handle.registerTimer(max(-(-min(map(self._micros, rows)) // 1000), watermark + 1))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.schema.fieldNames())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = []
        for frame in rows:
            held = []
            for row in _rows(frame):
                # what has no key or time can't be blocked
                (passed if key[0] is None or row[self.at] is None else held).append(row)
            if held:
                self.waiting.appendList(held)
                self._wake(held, timerValues.getCurrentWatermarkInMs())
        if passed:
            yield self._frame(passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in held if self._micros(r) <= now), key=lambda r: tuple(
            (r[i] is not None, r[i]) for i in self.order))
        if due and len(due) < len(held):
            later = [r for r in held if self._micros(r) > now]
            self.waiting.put(later)
            self._wake(later, now // 1000)
        elif due:
            self.waiting.clear()
        last = self.accepted.get()[0] if self.accepted.exists() else None
        out, before = [], last
        for row in due:
            if last is None or self._micros(row) - last >= self.ttl:
                last = self._micros(row)
                out.append(row)
        if last is not None and last + self.ttl <= now:  # nothing that is still to come can be blocked by it
            self.accepted.clear()
        elif last != before:
            self.accepted.update((last,))
            self.handle.registerTimer(-(-(last + self.ttl) // 1000))
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def first_in_event_order(stream: DataFrame, key: str, at: str, order: Sequence[str],
                         ttl_seconds: int = fv.TTL_SECONDS, late: str = "1 hour") -> DataFrame:
    """ST2, ST3. A key passes, then is held back until the time to live after that moment, in event time.

    Rows come out once the watermark (``late`` behind the newest row) has passed them, and rows later than that are
    lost, as everywhere with watermarks. ``order`` must begin with ``at`` and decides between rows of one moment. Rows
    without key or time pass at once.
    """
    use_state_store(stream.sparkSession)
    return stream.withWatermark(at, late).groupBy(key).transformWithStateInPandas(
        statefulProcessor=_EventOrder(stream.schema, key, at, order, ttl_seconds),
        outputStructType=stream.schema, outputMode="Append", timeMode="EventTime")


class _FirstWins(StatefulProcessor):
    """Accepted links and the last accepted titles of a key."""

    def __init__(self, columns: list[str], order: Sequence[str], horizon: int, threshold: float, ttl_ms: int | None):
        self.columns, self.order = columns, list(order)
        self.horizon, self.threshold, self.ttl_ms = horizon, threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.titles = handle.getListState("titles", "title string")
        self.links = handle.getMapState("links", "link string", "seen boolean", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        held = [r[0] for r in self.titles.get()] if self.titles.exists() else []
        recent = RecentTitles(held, self.horizon, self.threshold)
        verdicts = []
        for link, title in zip(map(_plain, batch["link"]), map(_plain, batch["norm_title"])):
            if link is not None and self.links.containsKey((link,)):
                verdicts.append(SAME_LINK)
            elif recent.has_like(title or ""):
                verdicts.append(SIMILAR)
            else:
                verdicts.append(ACCEPTED)
                recent.add(title or "")
                if link is not None:
                    self.links.updateValue((link,), (True,))
        if ACCEPTED in verdicts:
            self.titles.put([(t,) for t in recent.titles()])
        yield batch[self.columns].assign(verdict=verdicts)

    def close(self) -> None:
        pass


def first_wins_stream(stream: DataFrame, key: str, order: Sequence[str], horizon: int = fv.RECENT_TITLES,
                      threshold: float = fv.SIMILARITY, link_ttl_seconds: int | None = None) -> DataFrame:
    """ST4, G1 on a stream. Adds ``verdict``; per ``key`` (a source, or one constant for all) the batches are taken in turn, and the
    rows of one in ``order``. A key's batch lies in one task, so bound it with the source's files per trigger.
    """
    use_state_store(stream.sparkSession)
    # the state's rows are named tuples: no column may begin with an underscore
    named = stream.withColumn("link", normalize_link(F.col("link"))).withColumn(
        "norm_title", F.coalesce(normalize_title(F.col("title")), F.lit("")))
    schema = T.StructType([*stream.schema.fields, T.StructField("verdict", T.StringType())])
    processor = _FirstWins(stream.columns, order, horizon, threshold, None if link_ttl_seconds is None else link_ttl_seconds * 1000)
    return named.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append",
        timeMode="None" if link_ttl_seconds is None else "ProcessingTime")
