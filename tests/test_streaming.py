"""The controller against a plain reading of its rule, across restarts and odd rows."""

import random
import uuid
from datetime import datetime, timedelta, timezone

import pytest

from lattiq.streaming import controller, score

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "run long, ts timestamp, id long, value double"
RULE = controller.Rule(patience=3, idle_ms=60_000)


def plain(rows, late_ms):
    """Runs that have ended, read one row after another."""
    ms = {r: (r[1] - BASE) // timedelta(milliseconds=1) for r in rows if r[1]}
    mark = max(ms.values()) - late_ms
    out = {}
    for run in {r[0] for r in rows} - {None}:
        best, best_id, since, steps, last, reason = None, None, 0, 0, None, None
        for r in sorted((r for r in ms if r[0] == run and ms[r] < mark), key=lambda r: (r[1], r[2])):
            if last is not None and ms[r] - last > RULE.idle_ms:
                reason = "silent"
                break
            steps, last, since = steps + 1, ms[r], since + 1
            if r[3] is not None and r[3] == r[3] and (best is None or r[3] < best):
                best, best_id, since = r[3], r[2], 0
            if since >= RULE.patience:
                reason = "stalled"
                break
        if reason is None and last is not None and mark > last + RULE.idle_ms:
            reason = "silent"
        if reason:
            out[run] = (reason, steps, best, best_id)
    return out


def replay(spark, tmp_path, parts, late="10 seconds"):
    """Each part is one call, with the checkpoint of the call before it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", controller.ROCKSDB)
    folder, mark, name = tmp_path / "in", str(tmp_path / "mark"), f"t{uuid.uuid4().hex}"
    for no, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/part={no}")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")
        got = score.run_once(controller.ended_runs(stream, "run", "ts", "id", "value", RULE, late), name, "append", mark)
    rows = got.collect()
    assert len(rows) == len({r.key for r in rows})  # a run ends once
    return {r.key: (r.reason, r.steps, r.best, r.best_id) for r in rows}


def test_restarts_do_not_change_what_ends(spark, tmp_path):
    rng = random.Random(5)
    rows, at = [], {k: 0 for k in range(6)}
    for i in range(160):
        run = rng.randrange(6)
        at[run] = max(at.values()) + rng.choice([1, 5, 900, 4000])
        if run == 3 and i > 60:
            continue  # falls silent
        rows.append((run, BASE + timedelta(milliseconds=at[run]), i, 1000.0 - i if run == 3 else rng.choice([None, float("nan"), 100.0 - i, 100.0 - i, 50.0])))
    rows.sort(key=lambda r: r[1])
    # rows change places over a few seconds, within the watermark
    mixed = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=rng.random() * 4), r[2]))
    want = plain(rows, 10_000)
    assert {w[0] for w in want.values()} == {"stalled", "silent"}
    one = replay(spark, tmp_path / "one", [mixed])
    several = replay(spark, tmp_path / "several", [mixed[:50], mixed[50:90], mixed[90:]])
    assert one == want and several == want


def test_rows_without_key_or_time_and_no_rows(spark, tmp_path):
    late = BASE + timedelta(hours=1)
    rows = [(None, BASE, 1, 1.0), (1, None, 2, 0.0), (1, BASE, 3, None), (1, BASE, 4, 2.0), (1, BASE, 4, 2.0), (2, late, 5, 1.0)]
    assert replay(spark, tmp_path / "a", [rows]) == {1: ("silent", 3, 2.0, 4)}
    assert replay(spark, tmp_path / "b", [[]]) == {}


def test_a_rule_needs_patience():
    with pytest.raises(ValueError):
        controller.Rule(patience=0)
