"""URL filtering by host and path rules through an exact Bloom filter cascade.

Every url has a few candidate keys: each suffix of its host at a dot, with each path prefix of a
length that some rule has. Level 1 of the cascade is a Bloom filter of the listed keys. Level 2
encodes the keys of the corpus that pass level 1 without being listed, level 3 the listed keys
that pass level 2, and so on until no false positive is left: membership of any key of the
corpus is then exact, and testing a url is a chain of bit tests on literals, without a join.

All of it is DataFrame operations. The bits come to the driver; their number is bounded by
``max_bits`` and checked, and beyond that bound a shuffled equi-join gives the same answer.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``host`` (and its subdomains) with paths that start with ``path`` get ``verdict``."""

    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return f"{self.host}{self.path}"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substring_index(_rest(url), "/", 1)
    return F.translate(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    plain = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    return F.when(F.contains(plain, F.lit("/")), F.substr(plain, F.position(F.lit("/"), plain))).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.position(F.lit("://"), url)
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def candidate_keys(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """All keys under which a rule for this host and path could be listed: host suffixes by path prefixes."""
    labels = F.split(host, "\\.")
    depth = max((r.host.count(".") + 1 for r in rules), default=1)
    n = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(depth))),
        lambda k: F.array_join(F.slice(labels, n - k + F.lit(1), k), "."),
    )
    lengths = sorted({len(r.path) for r in rules})
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths]))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(pairs)


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int


def _positions(key: Column, bits: int, hashes: int, seed: int) -> Column:
    """The bits of ``key``: one 64-bit hash for each hash function."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(seed * 64 + i), key), F.lit(bits)) for i in range(hashes)])


def _passes(key: Column, level: Level) -> Column:
    words = F.from_json(F.lit(json.dumps(level.words)), "array<bigint>")
    return F.forall(
        _positions(key, level.bits, level.hashes, level.seed),
        lambda p: F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == F.lit(1),
    )


def _build(keys: DataFrame, bits: int, hashes: int, seed: int) -> Level:
    """A Bloom filter of ``keys`` (column ``key``): bits are or-ed by word before they reach the driver."""
    words = (
        keys.select(F.explode(_positions(F.col("key"), bits, hashes, seed)).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("at"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("word"))
    )
    out = [0] * (-(-bits // 64))
    for row in words.collect():
        out[row["at"]] = row["word"]
    return Level(tuple(out), bits, hashes, seed)


def build_cascade(listed: DataFrame, universe: DataFrame, per_key: float = 10.0, max_bits: int = 1 << 26, max_levels: int = 40) -> list[Level] | None:
    """Levels that tell ``listed`` keys exactly from all other keys of ``universe`` (columns ``key``).

    Only keys of the universe that pass a level are kept for the next, so what is shuffled after
    level 1 is about 1 % of it. None if a level would need more than ``max_bits`` bits.
    """
    levels: list[Level] = []
    hashes = max(1, round(per_key * math.log(2)))
    inside, other = cut(listed.select("key").distinct()), universe
    while n := inside.count():
        bits = max(64, 64 * math.ceil(per_key * n / 64))
        if bits > max_bits or len(levels) >= max_levels:
            return None
        levels.append(level := _build(inside, bits, hashes, len(levels)))
        passed = other.where(_passes(F.col("key"), level)).distinct()
        if len(levels) == 1:
            passed = passed.join(listed, "key", "left_anti")
        inside, other = cut(passed), inside
    return levels


def member(key: Column, levels: Sequence[Level]) -> Column:
    """Whether ``key`` is listed: the first level that it fails decides, odd levels say no and even ones yes."""
    out = F.lit(bool(len(levels) % 2))
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(_passes(key, levels[i]), out).otherwise(F.lit(bool(i % 2)))
    return out


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", per_key: float = 10.0, max_bits: int = 1 << 26) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest
    fitting rule (host and path together, of equal ones the longer host) wins and gives the verdict, ``default`` where none fits.
    Defined cases: a null url or one without ``://`` has empty host and path and fits no rule;
    repeated rows are judged each on its own; an empty table or no rules give no rows or only
    ``default``; other columns are ignored.
    """
    spark = pages.sparkSession
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not rules:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keyed = judged.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), rules))
    listed = rule_table(spark, rules)
    universe = keyed.select(F.explode("keys").alias("key"))
    # One cascade for the keys of each verdict: which one knows a key says what it gets, without a lookup.
    cascades = {v: build_cascade(listed.where(F.col("verdict") == v).select("key"), universe, per_key, max_bits) for v in sorted({r.verdict for r in rules})}
    if any(levels is None for levels in cascades.values()):
        return _judge_by_join(judged, keyed, rules, default)

    def verdict_of(k: Column) -> Column:
        return F.coalesce(*[F.when(member(k, levels), F.lit(v)) for v, levels in cascades.items()])

    hits = F.filter(F.transform("keys", lambda k: F.struct(k.alias("key"), verdict_of(k).alias("verdict"))), lambda x: x["verdict"].isNotNull())
    none = F.lit(None).cast("struct<key:string,verdict:string>")
    best = F.reduce(hits, none, lambda a, x: F.when(a.isNull() | (F.length(x["key"]) >= F.length(a["key"])), x).otherwise(a))
    return keyed.withColumn("best", best).select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: Sequence[UrlRule]) -> DataFrame:
    """The rules as a relation that needs no Python to be read: ``key, verdict``."""
    text = json.dumps([{"key": k, "verdict": v} for k, v in {r.key: r.verdict for r in rules}.items()])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<key:string,verdict:string>>")))


def _judge_by_join(judged: DataFrame, keyed: DataFrame, rules: Sequence[UrlRule], default: str) -> DataFrame:
    """The same by equi-join, for lists whose filters would outgrow ``max_bits``."""
    known = rule_table(judged.sparkSession, rules)
    hits = keyed.select("host", "path", "keys").distinct().select("host", "path", F.explode("keys").alias("key")).join(known, "key")
    best = hits.groupBy("host", "path").agg(F.min_by(F.struct(F.col("key").alias("rule"), "verdict"), F.struct(-F.length("key"), -F.position(F.lit("/"), F.col("key")))).alias("best"))
    return judged.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
