"""Sequences dealt by shard and slab of time, against the plain machine over whole shards."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_sequences import CATALOG, ROOT, S, TWO, as_rows, rules

from emberline.operators.match import match_rules
from emberline.operators.sequence import _in_blocks, correlate, correlate_blocks, in_cells, prepared, run_exact
from emberline.operators.sequence_state import Completed, Correlator
from emberline.plans.rules import compile_rules
from emberline.queries import rule_toml, sequence_toml


def timeline(spark, seed, n=600, shards=3):
    rnd, t, data = random.Random(seed), -400 * S, []
    for i in range(n):
        t += rnd.choice((0, 0, 1, 2, 3, 60)) * S
        data.append((i, t, rnd.choice((ROOT, ROOT, "port-scan", "service-probe")), rnd.choice((1, 2, None)), None if i % 50 == 0 else rnd.randrange(shards)))
    return spark.createDataFrame(data, "seq_no long, ts long, name string, pid long, shard long")


def plainly(matches, snapshot, **kw):
    """Every shard as one stream through one machine."""
    shards, out = defaultdict(list), []
    for r in prepared(matches, snapshot).orderBy("t", "event", "pos").collect():
        shards[r["shard"]].append(r)
    for shard, rows in shards.items():
        machine = Correlator(snapshot, **kw)
        for r in rows:
            at = f"{r['t']}:{r['event']}:{r['pos']}"
            for e in machine.on_match(r["rule_id"], r["t"], r["pid"], (at,)):
                if isinstance(e, Completed):
                    out.append((shard, "completed", e.root_rule, e.root[0], None, None, list(e.path), len(e.path), at))
                else:
                    out.append((shard, "step", e.root_rule, e.root[0], e.step, e.matched_rule, None, None, at))
    return sorted(map(str, out))


def many():
    """Sequences of several lengths and scopes over the same matches."""
    texts = [rule_toml(r, [("e.name", "==", r)]) for r in ("port-scan", "service-probe")]
    steps = {"a": ("", TWO), "b": ("pid", TWO), "c": ("pid", [("port-scan", "40s")]), "d": ("", [("d", "1s"), ("service-probe", "3s"), ("port-scan", "2s")])}
    texts += [rule_toml(k, [("e.name", "==", ROOT)], tail=sequence_toml(f"s-{k}", v, scope=scope)) for k, (scope, v) in steps.items()]
    return compile_rules(texts, CATALOG)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("most", (3, 256))
def test_cells_same_as_whole_shards(spark, seed, most):
    matches = match_rules(timeline(spark, seed), many()).cache()
    want = plainly(matches, many(), most=most)
    assert want and as_rows(correlate(matches, many(), most=most)) == want
    assert as_rows(run_exact(prepared(matches, many()), many(), most=most)) == want
    matches.unpersist()


def test_counted_thresholds_same_as_whole_shards(spark):
    own = rule_toml(ROOT, [("e.name", "==", ROOT)], tail=sequence_toml("t", [("port-scan", "30s")], "threshold", more="threshold = 3\n"))
    snapshot = compile_rules([own, rule_toml("port-scan", [("e.name", "==", "port-scan")])], CATALOG)
    matches = match_rules(timeline(spark, 7), snapshot)
    want = plainly(matches, snapshot, counted_thresholds=True)
    assert want and as_rows(run_exact(prepared(matches, snapshot), snapshot, counted_thresholds=True)) == want


def test_a_hot_shard_is_many_cells(spark):
    matches = match_rules(timeline(spark, 3, shards=1), rules(TWO))
    cells = in_cells(prepared(matches, rules(TWO)), rules(TWO))
    sizes = cells.where("shard = '0'").groupBy("slab").agg(F.count_if("own").alias("own"), F.count(F.lit(1)).alias("n")).collect()
    assert len(sizes) > 20 and sum(r["own"] for r in sizes) == prepared(matches, rules(TWO)).where("shard = '0'").count()
    assert sum(r["n"] for r in sizes) < 1.6 * sum(r["own"] for r in sizes)


def test_one_shuffle_for_all_sequences(spark):
    out = correlate(match_rules(timeline(spark, 3), many()), many())
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"[-] Exchange hashpartitioning\((.*?), \d+\), REPARTITION", final)]
    assert dealt == ["shard, slab"] and final.count("ReusedExchange") == 2


@pytest.mark.parametrize("block_rows", (3, 40, 10**6))
def test_blocks_same_as_whole_shards(spark, block_rows):
    """Without a cap of instances, for sequences of all lengths, some as long as the data."""
    texts = [rule_toml(r, [("e.name", "==", r)]) for r in ("port-scan", "service-probe")]
    steps = {"a": ("", [("port-scan", "1h"), ("service-probe", "90d"), ("port-scan", "2m")]), "b": ("pid", [("b", "1s"), ("service-probe", "90d")]), "c": ("pid", [("port-scan", "40s")])}
    texts += [rule_toml(k, [("e.name", "==", ROOT)], tail=sequence_toml(f"s-{k}", v, scope=scope)) for k, (scope, v) in steps.items()]
    snapshot = compile_rules(texts, CATALOG)
    matches = match_rules(timeline(spark, 5, shards=2), snapshot).cache()
    want = plainly(matches, snapshot, most=10**9)
    assert len(want) > 300 and as_rows(correlate_blocks(matches, snapshot, block_rows)) == want
    assert as_rows(correlate_blocks(matches.limit(0), snapshot, block_rows)) == []
    matches.unpersist()


def test_one_container_is_many_blocks(spark):
    rows = spark.range(50_000).selectExpr("'all' AS shard", "id * 1000 AS t", "id AS event", "0 AS pos", "'r' AS rule_id", "1L AS pid")
    sizes = [r["count"] for r in _in_blocks(rows, 1000).groupBy("shard", "block").count().collect()]
    assert len(sizes) == 50 and max(sizes) <= 1001
