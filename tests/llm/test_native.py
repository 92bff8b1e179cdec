"""Mixing, url filter, exact and line deduplication against SQL on odd tables."""

import random

import pytest
from odd import ODD, TWICE, frame, got_rows, sql_rows

from emberline.llm.exact_dedup import digests, exact_groups, salt_winners
from emberline.llm.line_dedup import dedup_lines
from emberline.llm.mixing import mix_sources
from emberline.llm.queries import ORACLE_SQL, OTHER, TARGETS, URL_RULES
from emberline.llm.url_filter import UrlRule, build_cascade, judge_urls, member
from pyspark.sql import functions as F


@pytest.mark.parametrize("data", [[r for r in ODD if r[0] is not None], []])
def test_exact_same_as_sql(spark, data):
    df = frame(spark, data)
    assert got_rows(exact_groups(df)) == sql_rows(ORACLE_SQL["op7_exact_dedup"], documents=df.select("doc_id", "text"))


def test_exact_nulls_and_repeats(spark):
    out = exact_groups(frame(spark, [*ODD, *TWICE, (None, "", "en", "a")]), salts=2).collect()
    assert len(out) == len(ODD) + 3
    twice = [r for r in out if r["doc_id"] == 20]
    assert [r["kept"] for r in twice] == [True, True] and twice[0]["group_size"] == 2
    blank = [r for r in out if r["text_sha256"] == [x for x in out if x["doc_id"] == 1][0]["text_sha256"]]
    assert {r["doc_id"] for r in blank} == {1, 2, None} and {r["keep_id"] for r in blank} == {1}
    assert all(r["kept"] for r in out if r["doc_id"] is None and r["keep_id"] is None)


@pytest.mark.parametrize("copies", [400, 40_000])
def test_exact_sends_one_row_a_text_and_task(spark, copies):
    """Rows that the local step leaves: four tasks, two texts, whatever the number of copies."""
    rows = spark.range(copies, numPartitions=4).selectExpr("id AS doc_id", "if(id % 10 = 0, 'some other text', repeat('hot text ', 20)) AS content").select("doc_id", *digests(F.col("content")), "content")
    sent = salt_winners(rows, 200)
    assert sent.count() == 8 and sent.agg(F.sum("n")).first()[0] == copies
    assert salt_winners(rows, 1).count() == 2


def test_exact_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same  text")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    out = exact_groups(df)
    assert out.where("kept").count() == 2001 and out.where("doc_id = 999").first()["keep_id"] == 0


@pytest.mark.parametrize("data", [[r for r in ODD if r[0] is not None], []])
def test_lines_same_as_sql(spark, data):
    df = frame(spark, data)
    assert got_rows(dedup_lines(df)) == sql_rows(ORACLE_SQL["op8_line_dedup"], documents=df.select("doc_id", "text"))


def test_lines_nulls_repeats_and_text(spark):
    out = dedup_lines(frame(spark, [*ODD, *TWICE]), with_text=True, carry=("lang", "carried")).collect()
    assert len(out) == len(ODD) + 2
    by = {r["doc_id"]: r for r in out}
    assert by[4]["kept_text"] == "own line of number four is here" and by[7]["n_dropped"] == 0
    assert by[1]["kept_text"] == "" and by[1]["n_lines"] == 1 and by[4]["carried"]["lang"] == "en"


def test_mix_same_as_sql(spark):
    data = [(i, "x" * (i * 37 % 900), "en", f"s{i % 7 if i % 3 else 0}") for i in range(400)] + [r for r in ODD if r[0] is not None]
    df = frame(spark, data)
    sql = ORACLE_SQL["op1_mix_sources"].replace("65536", "500")
    assert got_rows(mix_sources(df, block_chars=500, weights=TARGETS, other=OTHER)) == sql_rows(sql, documents=df.select("doc_id", "text", "source"))


def test_mix_deviation(spark):
    data = [(i, "x" * 100, "en", f"s{i % 10 if i % 2 else 0}") for i in range(3000)]
    frame_slots = 40
    out = mix_sources(frame(spark, data), block_chars=100, frame=frame_slots, least_slots=1).collect()
    share = {r["source"]: (r["deadline"] - r["release"], r) for r in out}
    assert len({(r["slot"], r["block_offset"], r["source"]) for r in out}) == len(out) and share
    slots = {}
    for r in out:
        assert r["release"] <= r["slot"] < r["deadline"]
        slots.setdefault(r["slot"], set()).add(r["source"])
    assert all(len(s) == 1 for s in slots.values())
    counts, shares = {}, {}
    for t in range(frame_slots):
        for s in slots[t]:
            shares[s] = shares.get(s, 0) + 1
    for t in range(min(max(r["slot"] for r in out if r["source"] == s) for s in shares)):
        for s in slots[t]:
            counts[s] = counts.get(s, 0) + 1
        assert all(abs(counts.get(s, 0) - (t + 1) * n / frame_slots) < 1 for s, n in shares.items())


def test_mix_odd_rows(spark, empty):
    assert mix_sources(empty).count() == 0
    out = mix_sources(frame(spark, [*ODD, *TWICE]), keep=("lang", "kept"))
    assert out.count() == len(ODD) + 2 and out.columns[-2:] == ["lang", "kept"]
    assert mix_sources(frame(spark, ODD), max_sources=1).count() == len(ODD)


@pytest.mark.parametrize("weights", [{"s0": 6, "s1": 3, "s2": 1}, {"s0": 1, "s1": 0.05, "s2": 0}])
def test_mix_target_weights_in_characters(spark, weights):
    rnd = random.Random(4)
    data = [(i, "x" * rnd.randint(0, 250), "en", f"s{i % 3}") for i in range(3000)]
    block = 100
    out = mix_sources(frame(spark, data), block_chars=block, frame=40, weights=weights).collect()
    total = {s: sum(r["n_chars"] for r in out if r["source"] == s) for s in weights}
    share = {s: len({r["slot"] for r in out if r["source"] == s and r["slot"] < 40 * 5}) / 200 for s in weights}
    least = min(w for w in weights.values() if w > 0)
    want = {s: max(w, least) for s, w in weights.items()}  # 0 counts as the smallest weight
    want = {s: w / sum(want.values()) for s, w in want.items()}
    ends = {s: total[s] / block / want[s] for s in want}
    chars, last = dict.fromkeys(want, 0), min(ends.values()) - 3
    by_slot = {}
    for r in out:
        by_slot.setdefault(r["slot"], []).append(r)
    for t in range(int(last)):
        for r in by_slot.get(t, []):
            chars[r["source"]] += r["n_chars"]
        assert all(abs(chars[s] - (t + 1) * block * want[s]) < block + 250 for s in want), (t, chars)
    assert len(out) == len(data) and share


def test_mix_holds_a_very_small_weight(spark):
    """One block in ten thousand: the frame grows until such a weight has whole slots."""
    data = [(i, "x" * 100, "en", "big" if i < 3950 else "small") for i in range(4000)]
    out = mix_sources(frame(spark, data), block_chars=10, weights={"big": 0.9999, "small": 0.0001}).collect()
    slots = {s: sorted(r["slot"] for r in out if r["source"] == s) for s in ("big", "small")}
    step = [b - a for a, b in zip(slots["small"], slots["small"][1:])]
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    # A document is ten blocks, of which the first counts: every ten thousandth slot is one of the small source.
    assert all(abs(x - 100_000) <= 20_000 for x in step) and slots["big"][-1] < 39_700


def test_mix_many_sources_in_groups(spark):
    data = [(i, "x" * 10, "en", f"s{i % 97}") for i in range(97 * 60)]
    out = mix_sources(frame(spark, data), block_chars=10, frame=50, weights={"s0": 20.0}, max_sources=20).collect()
    assert len(out) == len(data) and len({r["slot"] for r in out}) == len(out)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    first = [r["source"] for r in sorted(out, key=lambda r: r["slot"]) if r["slot"] < 200]
    assert 0.5 * 20 / 116 < first.count("s0") / 200 < 1.5 * 20 / 116 and len(set(first)) > 60


URLS = [
    (1, "http://www.example.net/en/1?x#y"), (2, "https://example.net/de/1"), (3, "http://EXAMPLE.com/de/x"), (4, "http://a.org/fr/"), (5, "http://a.org/fr"),
    (6, "no scheme"), (7, None), (8, ""), (9, "http://net"), (10, "http://net/"), (11, "http://example.net?x=/en/"), (12, "x://notexample.com/de/"), (13, "ftp://b.NET#/"), (14, "http:///de/"),
]


def test_urls_same_as_sql(spark):
    df = spark.createDataFrame(URLS * 2, "page_id long, url string").selectExpr("*", "'k' AS key", "'h' AS host", "'v' AS verdict")
    pages = df.select("page_id", "url").distinct()
    assert got_rows(judge_urls(pages, URL_RULES)) == sql_rows(ORACLE_SQL["op2_url_filter"], pages=pages)
    assert judge_urls(df, URL_RULES).count() == 2 * len(URLS)
    assert got_rows(judge_urls(pages, URL_RULES, max_bits=0)) == got_rows(judge_urls(pages, URL_RULES))
    assert judge_urls(df.limit(0), URL_RULES).count() == 0 and judge_urls(df, ()).where("verdict = 'allow'").count() == 2 * len(URLS)


def test_cascade_is_exact(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("key like '%7%'")
    levels = build_cascade(listed, universe, per_key=2.0)
    assert len(levels) > 2
    wrong = universe.where(member(F.col("key"), levels) != F.col("key").like("%7%"))
    assert wrong.count() == 0


def test_many_rules(spark):
    rules = [UrlRule(f"h{i}.com", f"/p{i % 5}/", "block" if i % 2 else "allow") for i in range(300)]
    df = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x.h"), F.col("id") % 400, F.lit(".com/p"), F.col("id") % 5, F.lit("/z")).alias("url"))
    want = {i: (f"h{i % 400}.com/p{i % 5}/" if i % 400 < 300 and i % 400 % 5 == i % 5 else None) for i in range(2000)}
    assert {r["page_id"]: r["rule"] for r in judge_urls(df, rules).collect()} == want
