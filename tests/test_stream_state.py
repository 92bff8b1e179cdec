"""Streams in event-time order: rows dealt over files in any order give the rows of the batch, and silent keys leave no state."""

import random

from test_sequences import ROOT, S, as_rows, rules

from emberline.operators.match import match_rules
from emberline.operators.sequence import correlate
from emberline.streaming.matching import stream_sequences
from emberline.streaming.ordered import start
from emberline.streaming.staleness import stream_stale_heartbeats
from emberline.streaming.watchdog import stream_lost_programs

SCHEMA = "seq_no long, ts long, name string, pid long, shard long"
TWO = [("port-scan", "10s"), ("service-probe", "15s")]


def in_batches(spark, files, schema, make, folder):
    """(output rows, progress) of a stream that gets each of ``files`` as a batch of its own, by runs that start anew."""
    (folder / "in").mkdir()
    progress = []
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in" / f"part={i:03}"))
        out = make(spark.readStream.schema(schema).parquet(str(folder / "in")))
        q = start(out, out.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True))
        q.awaitTermination()
        progress += [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    return spark.read.schema(out.schema).parquet(str(folder / "out")), progress


def test_state_of_a_silent_shard_goes(spark, tmp_path):
    snapshot = rules(TWO)
    files = [
        [(0, 0, ROOT, 1, 1), (1, 1 * S, ROOT, 1, 2), (2, 2 * S, "port-scan", 1, 2)],
        [(3, 5 * S, "service-probe", 1, 2), (4, 90 * S, ROOT, 1, 3)],
        [(5, 95 * S, "port-scan", 1, 3)],
        [(6, 99 * S, "service-probe", 1, 3), (7, 100 * S, ROOT, 1, 4)],
        [(8, 500 * S, "no rule", 1, 5)],
    ]
    out, progress = in_batches(spark, files, SCHEMA, lambda e: stream_sequences(e, snapshot, "1 second"), tmp_path)
    batch = as_rows(correlate(match_rules(spark.createDataFrame(sum(files, []), SCHEMA), snapshot), snapshot))
    assert batch and as_rows(out) == batch
    assert progress[-1]["numRowsTotal"] == 0


def test_shuffled_files_give_the_rows_of_the_batch(spark, tmp_path):
    """Rows up to 60 seconds out of order, ties in time, a session restart between files."""
    snapshot, rnd = rules(TWO, scope="pid"), random.Random(7)
    names = [ROOT, "port-scan", "service-probe", "unrelated", "no rule"]
    events = [(i, rnd.randint(0, 300) * S + rnd.choice([0, 0, 5]), rnd.choice(names), rnd.choice([1, 2, None]), rnd.choice([1, 1, 1, 2])) for i in range(500)]
    moved = sorted(events, key=lambda e: e[1] + rnd.randint(0, 59 * S))
    files = [moved[i : i + 100] for i in range(0, 500, 100)]
    assert any(max(r[1] for r in a) > min(r[1] for r in b) for a, b in zip(files, files[1:]))
    files.append([(999, 2000 * S, "no rule", 1, 1)])
    out, progress = in_batches(spark, files, SCHEMA, lambda e: stream_sequences(e, snapshot, "60 seconds"), tmp_path)
    batch = as_rows(correlate(match_rules(spark.createDataFrame(events, SCHEMA), snapshot), snapshot))
    assert len(batch) > 100 and as_rows(out) == batch
    assert progress[-1]["numRowsTotal"] == 0 and max(p["numRowsTotal"] for p in progress) > 0


BEATS = "key string, ts_ms long, nth long, n_progs int"


def shuffled_beats(seed, late_ms):
    """(heartbeats by key in order of time and arrival, the same over four files out of order)."""
    rnd, t, rows = random.Random(seed), 0, []
    for nth in range(240):
        t += rnd.choice((0, 0, 1, 400, 3000, 5000, 15000, 16000, 40000))
        rows.append((rnd.choice("aaab"), t, nth, rnd.choice((0, 3, 4, 4, 5))))
    moved = sorted(rows, key=lambda r: r[1] + rnd.randint(0, late_ms - 1))
    assert moved != rows
    return rows, [moved[i : i + 60] for i in range(0, 240, 60)]


def test_drops_over_shuffled_files(spark, tmp_path):
    rows, files = shuffled_beats(1, 60_000)
    files = [*files, [(None, 10**9, None, None), ("a", None, 0, 9), ("b", 1, 0, None)]]
    want = []
    for key in "ab":
        most, latched = 0, False
        for _, t, _, n in (r for r in rows if r[0] == key):
            most = max(most, n)
            low = 0 < most and n < most
            if low and not latched:
                want.append((key, t, 5, 2, "bpf-progs-zero-while-alive") if n == 0 else (key, t, 3, 1, f"bpf-progs-dropped-{n}-of-{most}"))
            latched = low
    out, _ = in_batches(spark, files, BEATS, lambda e: stream_lost_programs(e, "nth", "60 seconds"), tmp_path)
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) > 20


def test_every_key_fires_when_all_fall_silent(spark, tmp_path):
    """Ticks alone move the time after the last heartbeat; a tick short of the check moves nothing."""
    rows, files = shuffled_beats(2, 60_000)
    want = []
    last = max(r[1] for r in rows)
    for key in "ab":
        own = [r[1] for r in rows if r[0] == key]
        for t, following in zip(own, [*own[1:], None]):
            tick = -(-(t + 15000) // 5000) * 5000
            if following is None or tick < following:
                want.append((key, t, tick, tick - t))
    files += [[(None, last + 1000, None, None)], [(None, last + 200_000, None, None)]]

    def make(beats):
        return stream_stale_heartbeats(beats.where("key IS NOT NULL"), beats.where("key IS NULL"), "60 seconds")

    out, progress = in_batches(spark, files, BEATS, make, tmp_path)
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(want) and sum(r[1] >= last - 60_000 for r in got) >= 2
    assert progress[-1]["numRowsTotal"] == 0  # no key is kept after its alert


def test_many_keys_are_few_groups_of_state(spark, tmp_path):
    """Entries and timers of state belong to groups: as many keys as events must not mean as many calls; every key's rows stay its own."""
    keys, second = 3000, 1000
    beats = [(f"k{i}", second * (1 + i % 3), i, n) for i in range(keys) for n in (2 + i % 2,)]
    drops = [(f"k{i}", 10 * second, keys + i, 1) for i in range(keys)]
    out, progress = in_batches(spark, [beats + drops, [(None, 10**9, None, None)]], BEATS, lambda e: stream_lost_programs(e, "nth", "60 seconds"), tmp_path)
    assert sorted(map(tuple, out.collect())) == sorted((f"k{i}", 10 * second, 3, 1, f"bpf-progs-dropped-1-of-{2 + i % 2}") for i in range(keys))
    assert max(p["numRowsTotal"] for p in progress) < 2 * keys
