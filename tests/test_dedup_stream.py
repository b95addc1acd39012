"""Session deduplication as a stream: what it asks of its state, and its answers over several micro-batches."""

import os
import random

import pandas as pd

from codeloom.session_log import asked, written
from codeloom.streaming import dedup

COLUMNS = [c.split()[0] for c in dedup.REQUEST.split(", ")]


class Slots(dict):
    """A state map that counts the calls."""

    def __init__(self):
        super().__init__()
        self.calls = []

    def exists(self):
        self.calls.append("exists")
        return bool(self)

    def containsKey(self, key):
        self.calls.append("containsKey")
        return key in self

    def getValue(self, key):
        self.calls.append("getValue")
        return self.get(key)

    def updateValue(self, key, value):
        self.calls.append("updateValue")
        self[key] = value


class Handle:
    def __init__(self, slots):
        self.getMapState = lambda *_: slots


def test_a_batch_asks_for_a_slot_once_and_writes_it_once():
    slots = Slots()
    tracker = dedup.Tracker()
    tracker.init(Handle(slots))
    rows = pd.DataFrame([("s", i, i // 10, "k", "n", "p.py", 1, 9, i % 7 == 0) for i in range(500)], columns=COLUMNS)
    first = pd.concat(tracker.handleInputRows(("s", "p.py"), iter([rows[:300], rows[300:]]), None))
    assert len(first) == 500 and len(slots.calls) <= 4   # key, name and range are written
    slots.calls.clear()
    again = pd.concat(tracker.handleInputRows(("s", "p.py"), iter([rows.assign(turn=rows.turn + 50, force=False)]), None))
    assert again.is_deduplicated.all() and set(again.source_turn) == {49} and len(slots.calls) <= 3


def expected(requests):
    """The rules one request after the other."""
    spans, out = {}, {}
    for r in requests:
        session, seq, turn, key, name, path, start, stop, force = r
        found = next((spans[session, path, s] for s in asked(key, path, start, stop) if (session, path, s) in spans), None)
        if found and not force and found[0] < turn:
            out[seq] = (True, *found)
            continue
        out[seq] = (False, None, None, None, None)
        spans.update({(session, path, s): (turn, name, start, stop) for s in written(key, name, path, start, stop)})
    return out


def test_answers_over_micro_batches(spark, tmp_path):
    rng = random.Random(5)
    requests = []
    for seq in range(600):
        symbol, start = rng.choice(["a", "b", "c", None]), rng.choice([1, 5])
        requests.append((f"s{rng.randrange(4)}", seq, seq // 40, symbol and f"key {symbol}", symbol, rng.choice(["x.py", "y.py"]), start, start + 3, rng.random() < 0.1))
    for batch in range(3):
        part = requests[batch * 200:(batch + 1) * 200]
        rng.shuffle(part)
        path = tmp_path / "in" / f"{batch}.json"
        path.parent.mkdir(exist_ok=True)
        pd.DataFrame(part, columns=COLUMNS).to_json(path, orient="records", lines=True)
        os.utime(path, (1_000_000 + batch, 1_000_000 + batch))
    stream = spark.readStream.schema(dedup.REQUEST).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    (dedup.deduplicate_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
     .trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    session = {r[1]: r[0] for r in requests}
    assert len(rows) == 600 and all(r["session_id"] == session[r["seq"]] for r in rows)
    assert {r["seq"]: tuple(r)[2:] for r in rows} == expected(sorted(requests, key=lambda r: (r[2], r[1])))
