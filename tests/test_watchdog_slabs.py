"""Heartbeats dealt by slabs of time, against plain loops over each key."""

import random

import pytest

from emberline.operators import watchdog


def beats(seed):
    rnd, t, out = random.Random(seed), -20_000_000, []
    for _ in range(500):
        t += rnd.choice((1, 400, 3000, 4999, 15000, 16000, 40000, 900_000, 9_000_000))
        out.append((rnd.choice("aaaaab"), t, rnd.choice((0, 3, 4, 4, 5))))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_same_as_plain_loops(spark, seed):
    rows = beats(seed)
    df = spark.createDataFrame([*rows, ("a", None, 9), ("c", None, 1), (None, 5, 1)], "key string, ts_ms long, n_progs int").repartition(3)
    drops, stale = [], []
    for key in "ab":
        most, latched, own = 0, False, [r for r in rows if r[0] == key]
        for i, (_, t, n) in enumerate(own):
            most = max(most, n)
            low = 0 < most and n < most
            if low and not latched:
                drops.append((key, t, n, most))
            latched = low
            tick = -(-(t + 15000) // 5000) * 5000
            if i + 1 == len(own) or tick < own[i + 1][1]:
                stale.append((key, t, tick))
    got = watchdog.lost_programs(df, "key", "n_progs").collect()
    want = sorted((k, t, 5, 2, "bpf-progs-zero-while-alive") if n == 0 else (k, t, 3, 1, f"bpf-progs-dropped-{n}-of-{most}") for k, t, n, most in drops)
    assert sorted(map(tuple, got)) == want and len(want) > 50
    assert sorted(tuple(r)[:3] for r in watchdog.stale_heartbeats(df, "key").collect()) == sorted(stale)
    assert watchdog.in_slabs(df, "key").select("_slab").distinct().count() > 50
