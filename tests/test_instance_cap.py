"""The registered cap of live instances, and a small one against the plain state machine."""

import random
from collections import defaultdict

from oracle_compare import TABLES, difference
from pyspark.sql import functions as F
from test_sequences import ROOT, S, play, rules

from emberline import queries as engine
from emberline.operators.match import match_rules
from emberline.operators.sequence import correlate
from emberline.operators.sequence_state import Completed


def test_registered_with_the_default_cap(spark, monkeypatch):
    caps = []
    monkeypatch.setattr(engine, "correlate", lambda *a, **kw: caps.append(kw) or correlate(*a, **kw))
    engine.QUERIES["seq_instance_cap"](spark, "/root/testdata/sf0.001")
    assert caps == [{}]


def test_small_cap_same_as_plain_machine(spark):
    snapshot, rnd = rules([("port-scan", "1000s")]), random.Random(6)
    data = [(i, i * S, ROOT if rnd.random() < 0.9 else "port-scan", 1, rnd.randrange(3)) for i in range(400)]
    events = spark.createDataFrame(data, "seq_no long, ts long, name string, pid long, shard long")
    shards, want = defaultdict(list), 0
    for _, t, name, pid, shard in data:
        shards[shard].append((t // S, name, pid))
    for rows in shards.values():
        want += sum(isinstance(e, Completed) for out in play(snapshot, rows, most=20)[0] for e in out)
    out = correlate(match_rules(events, snapshot), snapshot, most=20).where("type = 'completed'").count()
    uncapped = correlate(match_rules(events, snapshot), snapshot).where("type = 'completed'").count()
    assert out == want and uncapped >= want


def test_busy_groups_lose_no_sequence(spark, tmp_path):
    """Queries whose SQL has no cap: five groups with more live instances than the cap, copies of one time among them."""
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").where("event_type IN ('click', 'purchase')")
    shift = events.agg(F.max("event_id") + 1).first()[0]
    copies = events.crossJoin(spark.range(60).withColumnRenamed("id", "copy"))
    copies = copies.withColumn("event_id", F.col("event_id") + F.col("copy") * shift).withColumn("user_id", F.col("user_id") + F.col("copy") * 150)
    # A month in two days.
    copies = copies.withColumn("ts", F.expr("timestamp_micros(unix_micros(cast(ts AS timestamp)) div 15)").cast("timestamp_ntz")).drop("copy")
    copies.write.parquet(str(tmp_path / "written"))
    spark.read.parquet(str(tmp_path / "written")).coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "events.parquet")
    for t in set(TABLES) - {"events"}:
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.01/{t}.parquet")
    for name in ("seq_pid_scoped", "seq_unscoped"):
        assert difference(engine.QUERIES[name](spark, str(tmp_path)), engine.ORACLE_SQL[name], str(tmp_path)) == ""
