"""Requests as a stream of events: roll-ups of each request, and answers released sentence by sentence."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit of an answer ends after one of these signs.
BOUNDARY = "[。！？!?；;\n]"


def request_fold(events: DataFrame) -> DataFrame:
    """One row per request (batch, or a stream in complete or update mode): first event, first delta, mode, latencies, downgrades.

    events: request_id, type, status, at, mode, latency_ms.
    """
    when = lambda t, c: F.when(F.col("type") == t, c)
    latency = when("generation.completed", F.greatest(F.lit(0.0), F.col("latency_ms")))
    failed = F.col("type").isin("ocr.completed", "vlm.completed", "generation.completed") & (F.col("status") == "failed")
    return events.groupBy("request_id").agg(
        F.min("at").alias("first_event"),
        F.min(when("answer.delta", F.col("at"))).alias("first_delta"),
        F.max_by("mode", F.when((F.col("type") == "retrieval.completed") & (F.col("mode") != ""), F.col("at"))).alias("mode"),
        F.count(latency).alias("n_calls"),
        F.round(F.avg(latency), 3).alias("mean_latency"),
        F.count_if(failed).alias("downgrades"),
        F.min(F.when(F.col("type").isin("run.completed", "run.failed"), F.col("at"))).alias("finished"),
    )


def registry(requests: DataFrame) -> DataFrame:
    """Requests and downgrades by retrieval mode."""
    return requests.groupBy(F.coalesce("mode", F.lit("none")).alias("mode")).agg(F.count("*").alias("n"), F.sum("downgrades").alias("downgrades"))


def units(text: Column) -> Column:
    """The units of a text, each with the sign that ends it; what follows the last sign is a unit too."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"(?<={BOUNDARY})"), lambda x: x != "")


def released(answers: DataFrame, supported) -> DataFrame:  # noqa: ANN001
    """answer_id, emitted and withheld text of whole answers (answer_id, text): supported is a condition on a unit; blank units pass."""
    rows = answers.select("answer_id", units(F.col("text")).alias("u"))
    good = lambda x: (F.btrim(x, F.lit(" \t\r\n")) == "") | supported(x)
    return rows.select("answer_id", F.array_join(F.filter("u", good), "").alias("emitted"), F.array_join(F.filter("u", lambda x: ~good(x)), "").alias("withheld"))


def buffered_units(deltas: DataFrame) -> DataFrame:
    """A stream of answer parts (answer_id, seq, delta, last) as whole units: answer_id, place, unit.

    What is not ended yet waits in the answer's state, which goes with its last part.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import re

        pending, place = state.get if state.exists else ("", 0)
        rows, ended = pd.concat(list(parts)).sort_values("seq"), False
        for delta, last in zip(rows["delta"], rows["last"], strict=True):
            pending, ended = pending + (delta or ""), ended or bool(last)
        found = [x for x in re.split(f"(?<={BOUNDARY})", pending) if x]
        rest = ""
        if found and not ended and not re.search(f"{BOUNDARY}$", found[-1]):
            rest = found.pop()
        if ended:
            state.remove()
        else:
            state.update((rest, place + len(found)))
        yield pd.DataFrame({"answer_id": [key[0]] * len(found), "place": range(place, place + len(found)), "unit": found})

    return deltas.groupBy("answer_id").applyInPandasWithState(run, "answer_id string, place int, unit string", "pending string, place int", "append", GroupStateTimeout.NoTimeout)


def live_sessions(saves: DataFrame, ttl: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Lives of sessions (session_id, at): a save within the time to live prolongs the life; a stream closes it by its watermark."""
    by = saves.withWatermark("at", late).groupBy("session_id", F.session_window("at", ttl))
    return by.agg(F.count("*").alias("n_saves")).select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("expires_at"), "n_saves")
