"""Debounce and session flush over several files with late rows, against plain loops over all events in order."""

import datetime
import random
import time

from pyspark.sql import functions as F

from storyspark.streaming import streams, timers

START = datetime.datetime(2024, 5, 1)
MICROS = int(START.replace(tzinfo=datetime.UTC).timestamp()) * 1_000_000
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def written_files(spark, folder, rows, files, seed):
    """rows in files by time, each row up to four seconds late."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r[0] + rng.random() * 4)
    size = -(-len(order) // files)
    for k in range(files):
        part = [(i, START + datetime.timedelta(seconds=t), u, e, float(v), p) for t, i, u, e, v, p in order[k * size : (k + 1) * size]]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}")
        time.sleep(1.1)  # files are read in order of their times
    return MICROS + int(max(r[0] for r in rows) * 1000) * 1000 - 5_000_000


def events(seed, n=240):
    rng = random.Random(seed)
    t, out = 0.0, []
    for i in range(n):
        t += rng.choice([0.0, 0.1, 0.4, 0.7, 2.0, 3.0, 6.0])
        out.append((round(t, 3), i, rng.randrange(3), rng.choice(["view", "view", "view", "purchase", "signup"]), rng.randrange(250), f"p{rng.randrange(4)}"))
    return out


def stream(spark, folder):
    return streams.event_stream(spark, folder, "*.parquet")


def slow_debounce(times, until, quiet=3_000_000, longest=10_000_000):
    out, batch = [], []
    for t in [*times, None]:
        if batch:
            due = min(batch[-1] + quiet, batch[0] + longest)
            if due <= (until if t is None else t):
                out.append((batch[0], due, len(batch), "quiet" if batch[-1] + quiet == due else "longest"))
                batch = []
        batch += [t] if t is not None else []
    return out


def at(seconds):
    return MICROS + round(seconds * 1_000_000)


def test_debounce_over_files_with_late_rows(spark, tmp_path):
    rows = events(1)
    until = written_files(spark, f"{tmp_path}/e", rows, 5, 2)
    got = streams.run(timers.debounced(stream(spark, f"{tmp_path}/e"), "user_id", late="5 seconds"), "append", "debounce").collect()
    want = []
    for user in range(3):
        times = sorted(at(t) for t, _, u, *_ in rows if u == user and at(t) <= until)
        want += [(user, *x) for x in slow_debounce(times, until)]
    assert sorted((r["user_id"], r["first"], r["moment"], r["n"], r["why"]) for r in got) == sorted(want)
    assert {r["why"] for r in got} == {"quiet", "longest"}


def test_many_keys_share_a_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(timers, "GROUPS", 2)
    rows = [(k / 7, k, None if k % 31 == 30 else 2**60 + k % 31) for k in range(400)]
    df = spark.createDataFrame([(at(t), i, u) for t, i, u in rows], "t bigint, event_id bigint, user_id bigint")
    shown = df.select("event_id", F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("p").alias("props"))
    shown.coalesce(1).write.parquet(f"{tmp_path}/e/a.parquet")
    got = streams.run(timers.debounced(stream(spark, f"{tmp_path}/e/a.parquet"), "user_id", late="5 seconds"), "append", "debounce").collect()
    until = (at(rows[-1][0]) // 1000 - 5000) * 1000
    want = [(u, *x) for u in {u for *_, u in rows} for x in slow_debounce([at(t) for t, _, v in rows if u == v and at(t) <= until], until)]
    order = lambda x: (str(x[0]), *x[1:])
    assert sorted(((r["user_id"], r["first"], r["moment"], r["n"], r["why"]) for r in got), key=order) == sorted(want, key=order)


def slow_session(rows, until, pause=500_000):
    out, note, held, first, last = [], None, [], None, None
    for t, kind, own, entity in [*rows, (until, "stop", None, None)]:
        if held and last + pause <= t:
            out.append((note, first, last + pause, len(held), "idle"))
            held = []
        if kind == "entity":
            if held and note != own:
                out.append((note, first, t, len(held), "note"))
                held = []
            first = t if not held else first
            held = held if entity in held else [*held, entity]
            note, last = own, t
        elif kind == "key" and held:
            last = t
        elif kind == "end" and held:
            out.append((note, first, t, len(held), "end"))
            held = []
    return out


def test_sessions_over_files_with_late_rows(spark, tmp_path):
    rows = events(7)
    until = written_files(spark, f"{tmp_path}/e", rows, 4, 3)
    kinds = {"purchase": "end", "signup": "key", "view": "entity"}
    kind = F.when(F.col("event_type") == "purchase", "end").when(F.col("event_type") == "signup", "key").otherwise("entity")
    shown = stream(spark, f"{tmp_path}/e").select("user_id", "ts", "event_id", kind.alias("kind"), F.floor(F.col("value") / 100).cast("string").alias("note"), F.col("props").alias("entity"))
    got = streams.run(timers.flushed(shown, "user_id", late="5 seconds"), "append", "sessions").collect()
    want = []
    for user in range(3):
        own = sorted((at(t), i, kinds[e], str(int(v // 100)), p) for t, i, u, e, v, p in rows if u == user and at(t) <= until)
        want += [(user, *x) for x in slow_session([(t, k, n, p) for t, _, k, n, p in own], until)]
    assert sorted((r["user_id"], r["note"], r["first"], r["moment"], r["n"], r["why"]) for r in got) == sorted(want)
    assert {r["why"] for r in got} == {"idle", "note", "end"}


def test_a_machine_at_equal_times():
    rows = [(0, 0, {}), (3, 1, {}), (3, 2, {}), (5, 3, {})]
    assert timers.advanced(timers.Debounce(3, 10), rows, 8) == [(0, 3, 1, "quiet"), (3, 8, 3, "quiet")]
    assert timers.advanced(timers.Debounce(3, 4), [(k, k, {}) for k in range(6)], 6) == [(0, 4, 4, "longest")]
    idle = timers.Debounce(3, 4)
    assert idle.idle() and timers.advanced(idle, [], 100) == []
