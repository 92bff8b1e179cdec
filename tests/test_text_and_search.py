import struct

import pytest
from pyspark.sql import functions as F

from emberline.functions import names as N
from emberline.functions import text as T
from emberline.functions.hashing import blake3_hex
from emberline.operators import budget, chunking, incremental, patterns, retrieval, sampling, trace, watchdog
from emberline.sources.wire import decode_events


@pytest.mark.parametrize(
    "scores, want",
    [([0.92, 0.87, 0.85, 0.41, 0.38], 3), ([0.9, 0.85, 0.8, 0.75], 4), ([0.5], 1), ([0.9, 0.4], 1), ([0.8, 0.8, 0.8], 3), ([0.8, 0.6], 2), ([0.5, 0.0, 0.0], 1), ([0.0, 0.0], 1), ([0.0, 0.5], 2)],
)
def test_score_cliff(spark, scores, want):
    df = spark.createDataFrame([(0, i + 1, s) for i, s in enumerate(scores)], "g int, rank int, score double")
    assert budget.before_cliff(df, ["g"]).count() == want


def test_tiers(spark):
    rows = [(0, i + 1, s, "\n".join(f"line {k}" for k in range(20)), "f.rs", 1, 20, "function", "c", ["a", "b"]) for i, s in enumerate([0.92, 0.87, 0.65, 0.42, 0.38])]
    df = spark.createDataFrame(rows, "g int, rank int, score double, content string, file string, line_start int, line_end int, kind string, crate string, symbols array<string>")
    out = budget.tier_texts(budget.tier_budgets(df, ["g"])).orderBy("rank").collect()
    assert [r["tier"] for r in out] == ["full", "full", "trimmed", "metadata", "metadata"]
    assert [r["budget"] for r in out] == [3600, 3600, 3000, 900, 900]
    assert "// ... (12 lines omitted)" in out[2]["output"] and out[3]["output"] == "f.rs:1-20 [function] crate=c symbols=[a, b]"


def test_hard_cap():
    text = "\n\n".join(f"--- Result {i} (score 0.1, full) ---\n{'x' * 100}" for i in range(1, 6))
    cut = budget.hard_cap(text, 300, 5)
    assert "[Truncated: showing 2 of 5 results." in cut and budget.hard_cap("short", 10, 1) == "short"


@pytest.mark.parametrize("query, kind, want", [("lock", None, "lookup"), ("how does the lock work", None, "exploration"), ("find the lock handler", None, "lookup"), ("x", "struct", "exploration"), ("a b c d e f g h i", None, "exploration"), ("", None, "lookup")])
def test_intent(spark, query, kind, want):
    df = spark.createDataFrame([(query, kind)], "q string, k string")
    assert df.select(T.query_intent(F.col("q"), F.col("k"))).first()[0] == want


@pytest.mark.parametrize("text, size, overlap, want", [("a b c d e", 3, 1, ["a b c", "c d e", "e"]), ("", 3, 1, []), ("a", 3, 1, ["a"]), ("a b c", 2, 2, ["a b", "b c", "c"]), ("  a\n\tb ", 5, 1, ["a b"])])
def test_word_chunks(spark, text, size, overlap, want):
    assert spark.createDataFrame([(text,)], "t string").select(chunking.word_chunks(F.col("t"), size, overlap)).first()[0] == want


def test_source_chunks():
    text = "use x;\n\n/// Doc\n#[test]\nfn a() {\n    b();\n}\nstruct S;\n" + "fn big() { " + "w " * 40 + "}\n"
    chunks = chunking.split_source(text, 20)
    assert chunks[0][0].startswith("use x;") and chunks[0][1] == 0
    assert any(c[0].startswith("fn big() {") and c[1:] == (8, 8) for c in chunks)
    assert chunking.split_source("", 20) == [] and chunking.split_source("plain words", 20) == [("plain words", 0, 0)]


def test_source_metadata(spark):
    text = "/// Doc one\n/// two\npub fn alpha(x: u8) {\n    beta(x); println!(\"a\"); Thing(1);\n}\nstatic mut COUNT: u8 = 0;"
    r = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in chunking.source_metadata(F.col("t")).items()]).first()
    assert r["symbols"] == ["alpha"] and r["declared"] == ["alpha", "COUNT"] and r["calls"] == ["alpha", "beta", "Thing"]
    assert r["kind"] == "mixed" and not r["is_test"] and r["doc_comment"] == "/// Doc one\n/// two"


def test_paths(spark):
    df = spark.createDataFrame([("ws/kernel/boot-core/src/a/b.rs",), ("ws/kernel/boot-core/src/lib.rs",), ("docs/x.md",)], "p string")
    p = F.col("p")
    out = [tuple(r) for r in df.select(T.subsystem(p, "ws"), T.package_name(p), T.module_path(p)).collect()]
    assert out == [("kernel", "boot-core", "boot_core::a::b"), ("kernel", "boot-core", "boot_core"), ("docs", "", "")]


def test_containers(spark):
    paths = ["/system.slice/docker-abc.scope", "/kubepods/x/" + "a1" * 16, "/user.slice", "/containerd/x"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select(T.container_id(F.col("p")), T.container_runtime(F.col("p")))
    assert [tuple(r) for r in df.collect()] == [("abc", "docker"), ("a1" * 16, "k8s"), (None, "unknown"), (None, "containerd")]


def test_addresses(spark):
    df = spark.createDataFrame([("192.168.1.100",), ("999.1.1.1",), ("1.2.3",), ("01.2.3.4",), (None,)], "s string")
    assert [r[0] for r in df.select(N.parse_ip(F.col("s"))).collect()] == [3232235876, None, None, None, None]
    assert spark.range(1).select(N.swap_bytes(F.lit(0x01020304).cast("long"))).first()[0] == 0x04030201


def test_blake3():
    assert blake3_hex(b"").startswith("af1349b9f5f9a1a6") and blake3_hex(bytes(i % 251 for i in range(3073))).startswith("7124b49501012f81")


def test_wire_records(spark):
    header = struct.pack("<QQIIIIIB16s16s3x", 7, 8, 9, 10, 11, 12, 13, 8, b"bash\0junk", b"init\0", )
    exec_ = header + b"/bin/sh\0".ljust(128, b"\0") + struct.pack("<I4x", 7)
    sock = struct.pack("<QQIIIIIB16s16s3x", 1, 2, 3, 4, 5, 6, 7, 3, b"nc", b"sh") + struct.pack("<IHHB7x", 0x0100007F, 0x5000, 2, 1)
    df = spark.createDataFrame([(0, bytearray(exec_)), (1, bytearray(sock)), (2, bytearray(header[:40])), (3, bytearray(header[:36] + b"\x63" + header[37:]))], "seq_no long, raw binary")
    rows = {r["seq_no"]: r for r in decode_events(df).collect()}
    assert set(rows) == {0, 1}
    assert (rows[0]["kind"], rows[0]["comm"], rows[0]["filepath"], rows[0]["tgid"]) == ("Bprm", "bash", "/bin/sh", 13)
    assert (rows[1]["kind"], rows[1]["addr"], rows[1]["port"], rows[1]["op"]) == ("Socket", 0x7F000001, 80, 1)
    raw = {r["seq_no"]: r for r in decode_events(df, raw_compat=True).collect()}
    assert raw[1]["addr"] == 0x0100007F and raw[1]["port"] == 0x5000


def test_evidence_and_snippets(spark):
    text = "// first\nfn x() {\n  let a = 1;\n  hit();\n}\nlast"
    df = spark.createDataFrame([("a.rs", text), ("b.rs", None)], "path string, text string")
    r = patterns.evidence(df, "hit").collect()
    assert [(x["line_start"], x["code_snippet"], x["context"]) for x in r] == [(4, "hit();", "// first")]
    assert [x["snippet"] for x in patterns.snippets(df, "HIT").collect()] == ["fn x() {\n  let a = 1;\n  hit();\n}\nlast"]
    assert len(patterns.built_in("ws")) == 20


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    new = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], "path string, hash string")
    changes = incremental.file_changes(old, new)
    assert {r["path"]: r["status"] for r in changes.collect()} == {"a": "removed", "b": "same", "c": "changed", "d": "added"}
    points = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "file string, v int")
    chunks = spark.createDataFrame([("b", 20), ("c", 30), ("d", 40)], "file string, v int")
    after, state = incremental.reindex(points, chunks, changes)
    assert {tuple(r) for r in after.select("file", "v").collect()} == {("b", 2), ("c", 30), ("d", 40)} and state.count() == 3


def test_fusion_ties(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0)], "id string, score double")
    b = spark.createDataFrame([("z", 3.0), ("x", 2.0)], "id string, score double")
    assert [r["id"] for r in retrieval.rrf_merge([a, b], 3).collect()] == ["x", "z", "y"]


def test_filters(spark):
    points = spark.createDataFrame([(1, "code_chunk", "a.rs", ["f", "g"], False), (2, "code_chunk", "b.rs", ["f"], True)], "id int, type string, file string, declared array<string>, is_test boolean")
    run = lambda **k: [r["id"] for r in retrieval.scroll(points, retrieval.payload_filter(**k)).collect()]
    assert run(symbols=["f"]) == [1, 2] and run(symbols=["f", "g"]) == [1] and run(exclude_tests=True) == [1] and run(file="b.") == [2] and len(retrieval.payload_filter()) == 0


def test_trace(spark):
    rows = [(1, "a.rs", 0, 5, "function", ["f"], ["f", "g"], "fn f() { g() }", ""), (2, "b.rs", 0, 5, "function", ["g"], ["g", "h"], "fn g();", ""), (3, "c.rs", 0, 5, "function", ["h"], ["h", "f"], "x", "")]
    points = spark.createDataFrame(rows, "id int, file string, line_start int, line_end int, kind string, symbols array<string>, calls array<string>, text string, subsystem string")
    assert [r["id"] for r in trace.Tracer(points).callees("f", 3)] == [1, 2, 3]
    text = trace.trace(points, "g", "callers", 1)
    assert "Signature: fn g()" in text and "(none found)" not in text
    assert "[No definition found for 'nope']" in trace.trace(points, "nope", "callees")


def test_watchdog(spark):
    beats = spark.createDataFrame([("k", 0, 3, 1), ("k", 3000, 2, 1), ("k", 6000, 0, 1), ("k", 9000, 3, 1), ("k", 12000, 0, 1), ("k", 50000, 3, 1), ("k", 51000, 1, 9)], "key string, ts_ms long, n_progs int, pid int")
    own = watchdog.from_agent(beats, "key")
    assert own.count() == 6
    assert [(r["ts_ms"], r["kind"]) for r in watchdog.lost_programs(own, "key", "n_progs").orderBy("ts_ms").collect()] == [(3000, 1), (12000, 2)]
    assert [(r["last_ts"], r["fired_at"]) for r in watchdog.stale_heartbeats(own, "key").orderBy("last_ts").collect()] == [(12000, 30000), (50000, 65000)]


def test_token_bucket(spark):
    rows = [(i, i * 1000) for i in range(100)]
    df = spark.createDataFrame(rows, "i long, t long")
    assert sampling.token_bucket(df, ["i"], "t").where("shown").count() == 50


def test_mined_evidence_and_its_first_rows(spark):
    files = spark.createDataFrame([("b", "hit 1\n\n// note\n  hit 2"), ("a", "fn f\nx\nhit 3"), ("c", None), ("d", "")], "path string, text string")
    specs = [patterns.PatternSpec("p", "hit", "HIT", "why", ("t",), ("",)), patterns.PatternSpec("q", "none", "none", "", (), ("a", "a"))]
    found = patterns.mined_evidence(files, specs)
    want = [("p", "a", 3, 3, "hit 3", "fn f"), ("p", "b", 1, 1, "hit 1", ""), ("p", "b", 4, 4, "hit 2", "// note")]
    assert sorted(tuple(r) for r in found.collect()) == want
    lists = patterns.evidence_lists(found, 2).collect()
    assert [(r["pattern_name"], [tuple(e) for e in r["evidence"]]) for r in lists] == [("p", [w[1:] for w in want[:2]])]
    rows = {r["pattern_name"]: r for r in patterns.mine(files, files, specs).collect()}
    assert (rows["p"]["n_evidence"], rows["p"]["confidence"], rows["p"]["origin_path"], rows["p"]["snippet"]) == (3, 1.0, "a", "fn f\nx\nhit 3")
    assert (rows["q"]["n_evidence"], rows["q"]["confidence"], rows["q"]["origin_path"], rows["q"]["scope_paths"]) == (0, 0.5, "", ["a", "a"])


def test_cap_of_a_column_same_as_of_a_text(spark):
    from pyspark.sql import functions as F

    texts = ["", "short", "--- Result 1 ---\nabc", "--- Result 1 ---\nabc \n\n--- Result 2 ---\nde", "x" * 50, "ab --- Result 1 --- c", "intro\n\n--- Result 1 ---\n" + "y" * 40 + "\n\n--- Result 2 ---\nz"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id int, t string, n int")
    for cap in (5, 14, 20, 30, 45, 200):
        got = {r["id"]: r["c"] for r in df.select("id", budget.capped(F.col("t"), cap, F.col("n")).alias("c")).collect()}
        assert got == {i: budget.hard_cap(t, cap, i) for i, t in enumerate(texts)}, cap
