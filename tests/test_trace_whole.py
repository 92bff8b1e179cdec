"""Walks over the calls of whole texts, against brute force."""

import random

import pytest

from emberline import queries as engine
from emberline.operators import trace


def brute(docs, callers):
    words = {i: (t or "").lower().split() for i, t in docs}
    words = {i: w for i, w in words.items() if len(w) >= 3}
    edges = {(a, b) for a, u in words.items() for b, v in words.items() if v[2] in u[3:]}
    if callers:
        edges = {(b, a) for a, b in edges}
    seen = front = {i: 0 for i in words if i % 100 == 0}
    for d in (1, 2, 3):
        front = {b: d for a, b in edges if a in front and b not in seen}
        seen = front | seen
    return sorted(seen.items())


@pytest.mark.parametrize("name", ["trace_callees", "trace_callers"])
def test_walk_same_as_brute_force(spark, tmp_path, name):
    rnd = random.Random(4)
    docs = [(i, " ".join(rnd.choice("ABcdefghijklmnopqrstuvwxyz") + str(rnd.randrange(40)) for _ in range(rnd.randrange(1, 40)))) for i in range(0, 600, 3)]
    docs += [(700, None), (800, "one two three"), (900, f"x y z {'w ' * 20}last"), (901, "a b LAST d"), (902, "a b own d last")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["node"], r["depth"]) for r in engine.QUERIES[name](spark, str(tmp_path)).collect())
    want = brute(docs, callers="callers" in name)
    assert got == want and {d for _, d in want} == {0, 1, 2, 3}
    # Found only by a call beyond the 8th word and from a start other than the first five ids.
    if "callees" in name:
        assert (901, 1) in got


@pytest.mark.parametrize("callers", [False, True])
def test_points_same_as_edges(spark, callers):
    rnd = random.Random(8)
    points = spark.createDataFrame([(i, [f"s{rnd.randrange(30)}"], [f"s{rnd.randrange(30)}" for _ in range(2)]) for i in range(60)], "id long, symbols array<string>, calls array<string>")
    start = points.where("id < 2").selectExpr("id AS node")
    ends = ("callee", "caller") if callers else ("caller", "callee")
    want = sorted(map(tuple, trace.reachable(trace.call_edges(points), start, 3, *ends).collect()))
    assert sorted(map(tuple, trace.reachable_points(points, start, 3, callers).collect())) == want


def plain_walk(points, symbol, depth):
    """(nth, node, depth, direction) rows of the walk as two recursions that share what was visited."""
    visited, out = set(), []

    def visit(symbol, left, side):
        met = "symbols" if side == "callees" else "calls"
        for node in sorted(i for i, p in points.items() if symbol in (p[met] or []))[: 3 if side == "callees" else 5]:
            if node in visited:
                continue
            visited.add(node)
            out.append((len(out) + 1, node, depth - left + 1, side))
            if left > 1:
                names = list(dict.fromkeys(points[node]["calls"] or []))[:5] if side == "callees" else (points[node]["symbols"] or [])[:3]
                for name in names:
                    visit(name, left - 1, side)

    visit(symbol, depth, "callees")
    visit(symbol, depth, "callers")
    return out


@pytest.mark.parametrize("depth", [1, 3, 4])
def test_walks_of_many_symbols(spark, depth):
    rnd = random.Random(depth)
    name = lambda: f"s{rnd.randrange(25)}"
    data = [(i, [name() for _ in range(rnd.randrange(1, 4))], [name() for _ in range(rnd.randrange(0, 9))]) for i in range(80)] + [(90, None, ["s1"]), (91, ["s2"], None), (92, [], [])]
    points = spark.createDataFrame([(*r, "x") for r in data], "id long, symbols array<string>, calls array<string>, path string").repartition(3)
    known = {i: {"symbols": s, "calls": c} for i, s, c in data}
    starts = [(1, "s3"), (2, "s4"), (3, "missing"), (4, "s3")]
    got = {}
    for r in trace.trace_many(points, spark.createDataFrame(starts, "start long, symbol string"), depth).collect():
        got.setdefault(r["start"], []).append((r["nth"], r["node"], r["depth"], r["direction"]))
    for start, symbol in starts:
        assert sorted(got.get(start, [])) == plain_walk(known, symbol, depth)
    files = points.selectExpr("id", "'f' AS file", "1 AS line_start", "2 AS line_end", "'fn' AS kind", "symbols", "calls", "'fn x()' AS text")
    tracer = trace.Tracer(files)
    assert [r["id"] for r in tracer.callees("s3", depth)] == [n for _, n, _, side in sorted(got[1]) if side == "callees"]


def test_registered_walks(spark, tmp_path):
    rnd = random.Random(6)
    docs = [(i, " ".join(rnd.choice("abcdef") + str(rnd.randrange(9)) for _ in range(rnd.randrange(1, 14)))) for i in range(0, 900, 4)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = {i: t.split() for i, t in docs if len(t.split()) >= 3}
    points = {i: {"symbols": [w[2]], "calls": list(dict.fromkeys(w[3:]))} for i, w in words.items()}
    got = {}
    for r in engine.QUERIES["trace_walks"](spark, str(tmp_path)).collect():
        got.setdefault(r["start"], []).append((r["nth"], r["node"], r["depth"], r["direction"]))
    assert {k: sorted(v) for k, v in got.items()} == {i: plain_walk(points, p["symbols"][0], 3) for i, p in points.items() if i % 100 == 0}


def test_levels_are_those_of_edges(spark, monkeypatch):
    """Walks by levels are those of joined edges, whether or not what a level asks for is sent to all tasks."""
    rnd = random.Random(3)
    rows = [(i, [f"s{i % 40}"], [f"s{rnd.randrange(60)}" for _ in range(rnd.randrange(4))]) for i in range(80)]
    points = spark.createDataFrame(rows, "id long, symbols array<string>, calls array<string>")
    start = spark.createDataFrame([(0,), (7,)], "node long")
    edges = trace.call_edges(points)
    for most in (10**6, 0):
        monkeypatch.setattr(trace, "MOST_SENT", most)
        for callers, (source, target) in ((False, ("caller", "callee")), (True, ("callee", "caller"))):
            got = sorted(map(tuple, trace.reachable_points(points, start, 3, callers=callers).collect()))
            assert got == sorted(map(tuple, trace.reachable(edges, start, 3, source, target).collect())) and len(got) > 4
