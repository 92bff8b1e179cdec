"""Lost programs where the order of heartbeats, or a heartbeat, is less than plain."""

import datetime
import random

import duckdb
import pytest
from oracle_compare import rows as counted

from emberline import queries as Q
from emberline.operators import watchdog
from emberline.stream_queries import stream_progs_dropped

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def by_loops(beats):
    """Drops of ``(key, ts_ms, arrival, n_progs)``; nulls come last among equals."""
    out, states = [], {}
    for key, t, _, n in sorted(beats, key=lambda r: (r[1], r[2], r[3] is None, r[3] or 0)):
        most, latched = states.get(key, (0, False))
        most = max(most, n or 0)
        low = n is not None and 0 < most and n < most
        if low and not latched:
            out.append((key, t, 5, 2, "bpf-progs-zero-while-alive") if n == 0 else (key, t, 3, 1, f"bpf-progs-dropped-{n}-of-{most}"))
        states[key] = most, low
    return sorted(out)


@pytest.mark.parametrize("arrivals", [1, 2, 1000])
def test_ties_go_by_arrival_and_number_however_rows_are_dealt(spark, arrivals):
    rnd, t, beats = random.Random(arrivals), 0, []
    for nth in range(600):
        t += rnd.choice((0, 0, 0, 400, 900_000))
        beats.append((rnd.choice("aab"), t, nth % arrivals, rnd.choice((None, 0, 1, 2, 3, 4))))
    want = by_loops(beats)
    assert len(want) > 50
    for seed in range(3):
        random.Random(seed).shuffle(beats)
        df = spark.createDataFrame(beats, "key string, ts_ms long, nth long, n_progs int").repartition(3)
        assert sorted(map(tuple, watchdog.lost_programs(df, "key", "nth").collect())) == want


def odd_events(spark, folder, first, n=600):
    """A folder with ``events`` from ``first`` on, no two in one tenth of a second, some of them without a user."""
    rnd, us, rows = random.Random(7), 0, []
    for i in range(n):
        us += rnd.randint(100_000, 60_000_000)
        rows.append((i, first + datetime.timedelta(microseconds=us), rnd.choice((None, 1, 2, 3, 4, 5, 9)), rnd.choice("aab"), 1.0, "{}"))
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def same_as_sql(query, name, spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet/*.parquet'")
    rel = con.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    want, df = counted(names, rel.fetchall()), query(spark, sf_dir)
    assert sum(want.values()) > 50
    assert counted(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.parametrize("year", [1969, 2024])
def test_batch_is_its_sql(spark, tmp_path, year):
    """Times before 1970 are cut toward zero, as SQL's division of whole numbers does."""
    same_as_sql(Q.progs_dropped, "progs_dropped", spark, odd_events(spark, tmp_path, datetime.datetime(year, 3, 1)))


def test_stream_is_its_sql(spark, tmp_path):
    """A heartbeat without a number ends a drop, so the next one below the most is told."""
    same_as_sql(stream_progs_dropped, "progs_dropped", spark, odd_events(spark, tmp_path, datetime.datetime(2024, 3, 1)))
