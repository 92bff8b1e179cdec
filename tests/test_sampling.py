"""Token buckets dealt by sessions, beside one loop over each group."""

import random

import pytest

from emberline.operators import sampling


@pytest.mark.parametrize("seed", range(3))
def test_sessions_same_as_one_loop(spark, seed):
    rnd, rows, t = random.Random(seed), [], -40 * 10**9
    for i in range(900):
        t += rnd.choice([0, 10**6, 5 * 10**7, 10**8, 2 * 10**9, 5 * 10**9, 5 * 10**9 + 1, 6 * 10**9, 400 * 10**9]) if rnd.random() < 0.03 else rnd.choice([0, 10**7])
        rows.append((i, rnd.choice(["a", "a", "a", "b", None]), t, "clash"))
    df = spark.createDataFrame([*rows, (5000, "a", None, ""), (5001, None, None, "")], "i long, g string, t long, _x string").repartition(5)
    got = {r["i"]: r["shown"] for r in sampling.token_bucket(df, ["i"], "t", "g").collect()}
    want, due = {5000: False, 5001: False}, {}
    for i, g, at, _ in rows:
        d = max(due.get(g, at), at)
        want[i] = d - at <= 49 * 10**8
        due[g] = d + 10**8 * want[i]
    assert got == want and 0 < sum(not x for x in want.values()) - 2 < 800


def test_one_group_is_many_tasks(spark):
    """Bursts an hour apart: each is a session of its own, and no window or task has the whole group."""
    df = spark.range(4000).selectExpr("id", "'' AS _group", "(id div 40) * 3600000000000 + id % 40 AS _t")
    sessions = sampling.with_sessions(df, 5 * 10**9, ["id"])
    assert sessions.select("_session").distinct().count() == 100
    assert sessions.select("_slab").distinct().count() == 100
