"""Streams with state: late, repeated and abandoned parts, lives of sessions, each with a restart from the checkpoint."""

import datetime

import pytest

from brindle.streaming import state

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def at(s):
    return START + datetime.timedelta(seconds=s)


@pytest.fixture
def run(spark, tmp_path):
    """Adds rows as one file and runs the stream over what is new, from its checkpoint."""
    folder, out = tmp_path / "in", tmp_path / "out"

    def go(rows, schema, made):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = made(spark.readStream.schema(schema).parquet(str(folder)))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(out)).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.parquet(str(out)).collect())

    return go


def supported(unit, evidence):
    return not any(c.isdigit() for c in unit) or any(w in evidence for w in unit.split())


def test_answers(run):
    schema = "answer_id string, seq int, delta string, last boolean, evidence string, at timestamp"
    made = lambda s: state.checked_answers(s, supported, patience_ms=60_000)
    first = [("a", 0, "Turn it off! Wait 5", False, "Wait 5 minutes", at(0)), ("a", 2, "s? Done", False, None, at(2)), ("b", 0, "Wait 9 hours! And th", False, "nothing", at(1)), ("a", 0, "Turn it off! Wait 5", False, None, at(1))]
    got = run(first, schema, made)
    assert got == [("a", 0, "Turn it off!", "emitted"), ("b", 0, "Wait 9 hours!", "withheld")]
    # the stream starts anew: the part that came early waits in the state, as does what is not ended
    got = run([("a", 1, " minute", False, None, at(3)), ("b", 1, "en stop", False, None, at(4))], schema, made)
    assert got[1:-1] == [("a", 1, " Wait 5 minutes?", "emitted")] and len(got) == 3
    got = run([("a", 3, " now", True, None, at(5)), ("c", 1, "never first", False, None, at(5))], schema, made)
    assert ("a", 2, " Done now", "emitted") in got and len(got) == 4
    # nothing comes for a minute: what is left of b and c goes, unseen
    got = run([("d", 0, "later!", False, "", at(300))], schema, made)
    assert [r for r in got if r[3] == "abandoned"] == [("b", 1, " And then stop", "abandoned"), ("c", 0, "", "abandoned")]
    assert ("d", 0, "later!", "emitted") in got and sum(r[0] == "a" for r in got) == 3
    got = run([("e", 0, "x", True, None, at(301))], schema, made)
    assert [r for r in got if r[3] == "abandoned"] == [("b", 1, " And then stop", "abandoned"), ("c", 0, "", "abandoned")]


def test_sessions(run):
    schema = "session_id string, owner string, products array<string>, at timestamp"
    made = lambda s: state.session_lives(s, ttl_ms=100_000)
    ms = lambda s: int(at(s).timestamp() * 1000)
    got = run([("s", "me", ["p1", "p2"], at(0)), ("s", "you", ["p1"], at(1)), ("s", "me", [], at(2)), ("t", None, None, at(2))], schema, made)
    assert got == [("s", ms(0), "saved", ["p1", "p2"], 1), ("s", ms(1), "refused", ["p1", "p2"], 1), ("s", ms(2), "saved", ["p1", "p2"], 2), ("t", ms(2), "saved", [], 1)]
    got = run([("s", "me", ["p3"], at(50)), ("s", "me", ["p3", "p1"], at(60))], schema, made)
    assert ("s", ms(50), "switched", ["p3"], 1) in got and ("s", ms(60), "saved", ["p3", "p1"], 2) in got
    got = run([("u", "x", ["p"], at(400))], schema, made)
    assert [r for r in got if r[2] == "expired"] == [("s", ms(160), "expired", ["p3", "p1"], 2), ("t", ms(102), "expired", [], 1)]
    got = run([("s", "you", ["p9"], at(410))], schema, made)
    assert ("s", ms(410), "saved", ["p9"], 1) in got
