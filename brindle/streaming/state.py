"""Streams with state that ends by itself: answers whose sentences are checked before they are shown, and the memory of sessions.

Both keep one small state a key and a timer in event time. The watermark fires the timer, so an answer that never ends and a session
that nobody comes back to leave the state without a further row; a restart from the checkpoint goes on with states and timers.
transformWithState works with the RocksDB state store alone: with_state_store() chooses it for the session.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brindle.streaming.requests import BOUNDARY

Check = Callable[[str, str], bool]


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Timed(StatefulProcessor):
    """One timer a key: the latest."""

    patience: int

    def _wait(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at + self.patience)

    def close(self) -> None:
        pass


class AnswerBuffer(_Timed):
    """Parts in the order of seq, whatever order they come in; each whole sentence once it is checked."""

    def __init__(self, check: Check, patience: int) -> None:
        self.check, self.patience = check, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("answer", "pending string, place int, next int, evidence string, done boolean")
        self.early = handle.getMapState("early", "seq int", "delta string, last boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        pending, place, following, evidence, done = self.state.get() if self.state.exists() else ("", 0, 0, "", False)
        latest = 0
        for r in rows:
            latest = max(latest, r["at_ms"])
            evidence = r["evidence"] if r["evidence"] is not None else evidence
            # a part that came before counts once
            if not done and r["seq"] >= following and not self.early.containsKey((r["seq"],)):
                self.early.updateValue((r["seq"],), (r["delta"] or "", bool(r["last"])))
        while not done and self.early.containsKey((following,)):
            delta, done = self.early.getValue((following,))
            self.early.removeKey((following,))
            pending, following = pending + delta, following + 1
        units = [u for u in re.split(f"(?<={BOUNDARY})", pending) if u]
        pending = units.pop() if units and not done and not re.search(f"{BOUNDARY}$", units[-1]) else ""
        for unit in units:
            good = not unit.strip() or self.check(unit, evidence)
            yield Row(answer_id=key[0], place=place, unit=unit, outcome="emitted" if good else "withheld")
            place += 1
        if done:
            self.early.clear()
        # an answer that has ended is remembered until its timer, so that late copies of its parts say nothing
        self.state.update((pending, place, following, evidence, done))
        self._wait(latest)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        if self.state.exists():
            pending, place, _, _, done = self.state.get()
            if not done:
                yield Row(answer_id=key[0], place=place, unit=pending, outcome="abandoned")
        self.state.clear()
        self.early.clear()


class SessionMemory(_Timed):
    """Saves of a session prolong its life; another owner is refused; products that share nothing with the last ones reset it."""

    def __init__(self, ttl: int) -> None:
        self.patience = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "owner string, products array<string>, n_saves int, expires long")

    def _row(self, key: tuple, at: int, outcome: str, products: list[str], n: int) -> Row:
        return Row(session_id=key[0], at_ms=at, outcome=outcome, products=list(products), n_saves=n)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        for r in sorted(rows, key=lambda r: (r["at_ms"], r["owner"] or "", r["products"] or [])):
            at, products = r["at_ms"], list(r["products"] or [])
            if held and at >= held[3]:
                yield self._row(key, held[3], "expired", held[1], held[2])
                held = None
            if held and r["owner"] != held[0]:
                yield self._row(key, at, "refused", held[1], held[2])
                continue
            before = list(held[1]) if held else []
            switched = bool(products and before and not set(products) & set(before))
            n = 1 if switched or not held else held[2] + 1
            held = (r["owner"], products or before, n, max(at + self.patience, held[3] if held else 0))
            yield self._row(key, at, "switched" if switched else "saved", held[1], n)
        if held:
            self.state.update(held)
            self._wait(held[3] - self.patience)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        if self.state.exists():
            _, products, n, expires = self.state.get()
            yield self._row(key, expires, "expired", products, n)
        self.state.clear()


def _timed(df: DataFrame, late: str) -> DataFrame:
    return df.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))


def checked_answers(deltas: DataFrame, check: Check, patience_ms: int = 60_000, late: str = "10 seconds") -> DataFrame:
    """A stream of parts (answer_id, seq from 0, delta, last, evidence, at) as answer_id, place, unit, outcome.

    check(unit, evidence) tells whether a sentence may be shown: emitted, else withheld. After patience_ms without a part the rest of
    an answer is abandoned: one row, never checked nor shown; parts that came before their turn go with it.
    """
    with_state_store(deltas.sparkSession)
    out = "answer_id string, place int, unit string, outcome string"
    return _timed(deltas, late).groupBy("answer_id").transformWithState(AnswerBuffer(check, patience_ms), out, "append", "EventTime")


def session_lives(saves: DataFrame, ttl_ms: int, late: str = "10 seconds") -> DataFrame:
    """A stream of saves (session_id, owner, products, at) as session_id, at_ms, outcome (saved, switched, refused, expired), products, n_saves."""
    with_state_store(saves.sparkSession)
    out = "session_id string, at_ms long, outcome string, products array<string>, n_saves int"
    return _timed(saves, late).groupBy("session_id").transformWithState(SessionMemory(ttl_ms), out, "append", "EventTime")
