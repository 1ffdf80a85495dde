"""Machines as streams and in batch: the same rows from the same frames, whatever the micro-batches."""

import random
import time

import pytest
from test_actions import FPS, random_scene

from framelake.operators import actions as A
from framelake.streaming import keyed

ROSTER = "segment string, frame long, det long, x double, y double, appearance array<double>"
PLAY = "segment string, frame long, state string, x double, y double, z double, speed double, people array<struct<player:string,hand:struct<x:double,y:double,z:double>,foot:struct<x:double,y:double>>>"


def people_rows():
    r = random.Random(3)
    looks = [[1.0, 0.0, 0.1], [0.0, 1.0, 0.1], [0.1, 0.0, 1.0]]
    rows = []
    for s in ("s", "t"):
        for f in range(0, 90):
            for d in range(3):
                if r.random() < 0.9 and not (d == 1 and 30 <= f < 70):
                    rows.append((s, f, d, 0.1 * f + 4 * d, float(d), looks[d]))
    return rows


def play_rows():
    rows = []
    for k, s in enumerate("st"):
        play = random_scene(k)
        t = play.rows(0)
        speed = (t[["vx", "vy", "vz"]] ** 2).sum(axis=1, skipna=False) ** 0.5
        for (_, x), v in zip(t.iterrows(), speed, strict=True):
            ball = [float(x[c]) if x[c] == x[c] else None for c in "xyz"]
            rows.append((s, int(x["frame"]), x["state"], *ball, float(v) if v == v else None, keyed._plain(x["people"])))
    return rows


def stream(spark, tmp_path, kind, schema, batches, idle=600.0, rows_after=()):
    """Rows of a stream fed one batch at a time, each when the last one is taken (and gave ``rows_after`` rows in all).

    Timers keep micro-batches coming, so the stream is never just idle.
    """
    source = str(tmp_path / "in")
    spark.createDataFrame([], schema).write.parquet(source)
    rows = spark.readStream.schema(schema).parquet(source)
    name = f"q{abs(hash(str(tmp_path)))}"
    query = keyed.run_stream(rows, ["segment"], kind, idle).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    taken, total = {}, 0
    try:
        for k, batch in enumerate(batches):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
            total, until = total + len(batch), time.time() + 120
            while sum(taken.values()) < total or (rows_after and spark.table(name).count() < rows_after[k]):
                assert query.isActive and time.time() < until, query.exception()
                taken |= {p["batchId"]: p["numInputRows"] for p in query.recentProgress}
                time.sleep(0.1)
    finally:
        query.stop()
    return sorted(map(str, spark.table(name).collect()))


@pytest.mark.parametrize(("kind", "schema", "make"), [(keyed.RosterMachine, ROSTER, people_rows), (keyed.PossessionMachine, PLAY, play_rows)])
def test_stream_gives_the_rows_of_the_batch(spark, tmp_path, kind, schema, make):
    rows = make()
    want = sorted(map(str, keyed.run_batch(spark.createDataFrame(rows, schema), ["segment"], kind).collect()))
    r = random.Random(1)
    last = max(x[1] for x in rows)
    cuts = [0, last // 3, 2 * last // 3, last + 1]
    batches = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        # A frame is split between two batches; rows come in any order, some twice.
        batch = [x for x in rows if a <= x[1] < b]
        split = [x for x in rows if x[1] == b - 1]
        early, late = [x for x in batch if x not in split[len(split) // 2 :]], split[len(split) // 2 :]
        r.shuffle(early)
        batches += [early + early[:7], late]
    # Rows of frames that are finished are late.
    batches.append([x for x in rows if x[1] < cuts[1]][:20])
    ends = [tuple([s, last + 100, *rows[0][2:]]) for s in ("s", "t")]
    got = stream(spark, tmp_path, kind, schema, [b for b in [*batches, ends] if b])
    assert got == want and len(got) > 100


def test_idle_keys_are_finished_and_forgotten(spark, tmp_path):
    rows = [("s", f, 0, 0.1 * f, 0.0, [1.0, 0.0]) for f in range(10)]
    other = [("t", f, 0, 0.1 * f, 0.0, [0.0, 1.0]) for f in range(3)]
    got = stream(spark, tmp_path, keyed.RosterMachine, ROSTER, [rows, other, other[2:], rows[:3]], idle=0.2, rows_after=(10, 13, 14, 17))
    first = sorted(map(str, keyed.run_batch(spark.createDataFrame(rows, ROSTER), ["segment"], keyed.RosterMachine).collect()))
    # The last frame of s came out when the timer ran; s then began anew with frames that would else be late, to their end.
    mine = [x for x in got if "segment='s'" in x]
    assert set(first) == set(mine) and len(mine) == len(first) + 3


def test_possession_in_batch_matches_the_segment_rules(spark):
    rows = play_rows()
    got = keyed.run_batch(spark.createDataFrame(rows, PLAY), ["segment"], keyed.PossessionMachine).collect()
    for k, s in enumerate("st"):
        found, owner = A.Scene(random_scene(k).rows(0), FPS).possession(A.ActionRules())
        mine = sorted((r for r in got if r["segment"] == s), key=lambda r: r["frame"])
        assert [r["owner"] for r in mine] == owner
        assert [(a["type"], a["frame"], a["actor"], a["receiver"]) for r in mine for a in r["actions"]] == [(x.type, x.frame, x.actor, x.receiver) for x in found]
