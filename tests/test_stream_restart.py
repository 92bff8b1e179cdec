"""Streams that stop in the middle: replayed batches have the rules and the ids that they had."""

import pytest
from pyspark.errors import StreamingQueryException

from emberline.plans.catalog import RuleError, bench_catalog
from emberline.queries import rule_toml
from emberline.streaming.ledger import Ledger
from emberline.streaming.numbering import number_batch, stream_response_ids
from emberline.streaming.reload import VersionedRules, run_with_reload

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def rule(folder, least, name="big"):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.toml").write_text(rule_toml(name, [("event.value", ">", least)]))


def put(spark, folder, part, values):
    rows = [(100 * part + i, None, 1, "click", float(v), "{}") for i, v in enumerate(values)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / f"part={part}"))


class Stop(Exception):
    pass


def test_replayed_batch_has_the_rules_that_it_had(spark, tmp_path):
    rules, data = tmp_path / "rules", tmp_path / "in"
    rule(rules, 10)
    got = {}

    def run(fail_at=None):
        def sink(matches, batch, version):
            got.setdefault(batch, []).append((version, sorted(r["event_id"] for r in matches.collect())))
            if batch == fail_at:
                raise Stop

        versions = VersionedRules(spark, str(rules), bench_catalog(), str(tmp_path / "state"), quiet_s=0.0)
        events = spark.readStream.schema(SCHEMA).parquet(str(data / "part=*"))
        run_with_reload(events, versions, sink, str(tmp_path / "checkpoint")).awaitTermination()

    put(spark, data, 0, [5, 15, 25])
    run()
    rule(rules, 20)
    put(spark, data, 1, [5, 15, 25])
    with pytest.raises(StreamingQueryException):
        run(fail_at=1)
    rule(rules, 0)  # while the stream is down
    run()
    put(spark, data, 2, [5, 15, 25])
    run()
    assert got == {0: [(1, [1, 2])], 1: [(2, [102]), (2, [102])], 2: [(3, [200, 201, 202])]}


def test_versions(spark, tmp_path):
    """Quiet time, bad and empty sets, a version that goes on in another process."""
    rules, now = tmp_path / "rules", [0.0]
    with pytest.raises(RuleError):
        VersionedRules(spark, str(rules), bench_catalog(), str(tmp_path / "none")).for_batch(0)
    rule(rules, 10)
    import os

    def at(name, seconds):
        os.utime(rules / f"{name}.toml", (seconds, seconds))

    def fresh():
        return VersionedRules(spark, str(rules), bench_catalog(), str(tmp_path / "state"), clock=lambda: now[0])

    v = fresh()
    at("big", 1000)
    now[0] = 1000.1
    assert v.for_batch(0)[1] == 1
    rule(rules, 20)
    at("big", 1005)
    now[0] = 1005.4
    assert v.for_batch(1)[1] == 1  # changed less than a second ago
    now[0] = 1006.1
    assert v.for_batch(2)[1] == 2 and v.for_batch(1)[1] == 1
    (rules / "bad.toml").write_text("not toml")
    at("bad", 1010)
    now[0] = 1020
    assert v.for_batch(3)[1] == 2 and v.last_error
    v = fresh()
    assert v.for_batch(2)[1] == 2 and [c.literal.value for r in v.for_batch(2)[0].rules for c in r.conditions] == [20]
    (rules / "bad.toml").unlink()
    (rules / "big.toml").unlink()
    assert v.for_batch(4)[1] == 2
    now[0] = 1022
    assert v.for_batch(5)[1] == 3 and not v.for_batch(5)[0].rules and not v.last_error


def test_ids_go_on_after_a_replay(spark, tmp_path):
    """A batch is written, but not its end: the replay gives the same ids, and the next batch goes on there."""
    data, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    put(spark, data, 0, range(7))
    rows = lambda: spark.readStream.schema(SCHEMA).parquet(str(data / "part=*")).select("event_id")
    stream_response_ids(rows(), ["event_id"], out, state).awaitTermination()
    put(spark, data, 1, range(5))
    ledger = Ledger(spark, f"{state}/ids", 100)
    number_batch(spark.read.parquet(str(data / "part=1")).select("event_id"), 1, ["event_id"], out, ledger)
    stream_response_ids(rows(), ["event_id"], out, state).awaitTermination()
    put(spark, data, 2, range(4))
    stream_response_ids(rows(), ["event_id"], out, state).awaitTermination()
    got = sorted((r["id"], r["event_id"]) for r in spark.read.option("basePath", out).parquet(out).collect())
    assert got == list(enumerate([*range(7), *range(100, 105), *range(200, 204)]))


def test_ledger(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"), kept=2)
    assert ledger.get(0) is None and ledger.before(5) is None
    for i in (0, 1, 7):
        ledger.put(i, {"n": i, "text": "ü"})
    assert ledger.batches() == [1, 7] and ledger.before(7) == (1, {"n": 1, "text": "ü"}) and ledger.get(7)["n"] == 7
    ledger.put(7, "anew")
    assert ledger.get(7) == "anew"
