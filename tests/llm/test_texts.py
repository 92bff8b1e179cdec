"""Packing, quality, licences and languages against plain versions on odd tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd import ODD, TWICE, frame

from emberline.llm import langid, packing, quality
from emberline.llm.license_scan import Matcher, TEMPLATES, scan_licenses, terms
from emberline.llm.queries import op9_language_id, tokenizer_path
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    data = [r for r in ODD if r[0] is not None]
    out = packing.pack_documents(frame(spark, data), path, open_bins=3, cached_chunks=50, with_ids=True).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text, *_ in data:
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[doc], key=lambda r: r["piece"])
        assert [i for r in own for i in r["ids"]] == want and len(own) == -(-len(want) // 2048)
        assert [r["start"] for r in own] == [2048 * r["piece"] for r in own]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) for r in own)
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack_documents(frame(spark, [*ODD, *TWICE]), path).count() == len(out) + 3
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def test_packing_on_many_tasks_and_in_stretches(spark):
    path = tokenizer_path("word_bpe_49k.json")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    used = {}
    for tasks in (1, 16, 64):
        out = packing.pack_documents(docs.repartition(tasks), path).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("first")).collect()
        assert all(r["n"] == r["end"] <= 2048 and r["first"] == 0 for r in out)
        used[tasks] = len(out)
    assert max(used.values()) <= min(used.values()) + 3
    ordered = docs.repartition(2).withColumn("place", F.floor(F.col("doc_id") / 300)).sortWithinPartitions("place")
    out = packing.pack_documents(ordered, path, stretch=F.col("place")).join(docs.select("doc_id", F.floor(F.col("doc_id") / 300).alias("own")), "doc_id").collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    of = defaultdict(set)
    for r in out:
        of[r["sequence_id"]].add(r["own"])
    assert sum(len(x) == 1 for x in of.values()) > 0.9 * len(of) and len({(r["sequence_id"], r["stretch"]) for r in out}) == len(of)


def test_chunked_tokens_equal_whole_texts():
    import random

    import pyarrow as pa

    tokenizer = packing.ChunkTokenizer(tokenizer_path("word_bpe_49k.json"), 400)
    rnd = random.Random(1)
    letters, pool = "aAbZé'ÉsS t.,!$<|>endoftext3٣ \n\tß…ñ×÷İİé≠’中文  🙂-_()", ["<|endoftext|>", "don't", "I'LL", "É.", "x²", "naïve", "<|ENDOFTEXT|>"]
    for _ in range(300):
        texts = ["".join(rnd.choice([rnd.choice(letters), rnd.choice(letters), rnd.choice(pool)]) for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(1, 4))]
        ids, ends = packing.token_ids(pa.array([*texts, None]), tokenizer, 0)
        for i, t in enumerate([*texts, ""]):
            assert ids[ends[i] : ends[i + 1]].tolist() == [*tokenizer.tokenizer.encode(t, add_special_tokens=False).ids, 0]


def test_best_fit_and_closing():
    p = packing.BinPacker(10, 2)
    assert p.place(6) == (0, 0) and p.place(7) == (1, 0) and p.place(3) == (1, 7) and p.place(5) == (2, 0)
    assert p.place(9) == (3, 0)  # the fullest open bin, 0, was closed
    assert p.place(5) == (2, 5)


def plain_counts(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_counts(spark):
    labels = labels_of(spark, [(4, 1, 0), (None, 0, 0), (99, 0, 0), (5, None, 0)])
    out = quality.judge_quality(frame(spark, [*ODD, *TWICE]), labels).collect()
    assert len(out) == len(ODD) + 2
    texts = {r[0]: r[1] for r in [*ODD, *TWICE]}
    for r in out:
        want = plain_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r["kept"] == (not r["base_failed"])
    assert quality.judge_quality(frame(spark, []), labels).count() == 0


def test_rules_are_learned_and_pruned():
    rnd = np.random.default_rng(0)
    x = {"a": rnd.random(3000), "b": rnd.random(3000), "noise": rnd.random(3000)}
    bad = (x["a"] > 0.8) & (x["b"] < 0.5) | (x["a"] < 0.1)
    rules = quality.learn_rules(x, bad, precision=0.9)
    found = np.zeros(3000, bool)
    for r in rules:
        found |= quality.covers(r, x)
    assert (found == bad).mean() > 0.97 and len(rules) <= 4
    assert quality.learn_rules(x, rnd.random(3000) < 0.05) == []


def test_quality_keeps_good_documents(spark):
    from emberline.llm.queries import op3_quality_rules

    out = op3_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    assert out.where("quality = 1 and not kept").count() == 0 and out.where("quality = 0 and kept").count() <= 5


LICENSES = [
    (1, "code here\nReleased under the MIT License.", "p/a/x.c"),
    (2, "plain text", "p/a/b/y.c"),
    (3, "Licensed under the Apache License,\nVersion 2.0.", "p/LICENSE"),
    (4, "nothing", "p/q/z.c"),
    (5, "nothing", "other.c"),
    (6, None, "p/a/n.c"),
    (7, "This work is licensed under the GNU General Public License, version 3.", "p/a/b/c/LICENSE"),
    (8, "x", "p/a/b/c/d/e.c"),
    (9, "Licensed under CC BY-NC 4.0.", None),
    (10, "", None),
]


def test_licenses(spark):
    df = spark.createDataFrame(LICENSES, "doc_id long, text string, path string").selectExpr("*", "'d' AS dir", "'l' AS license")
    named = F.endswith("path", F.lit("LICENSE"))
    out = {r["doc_id"]: r for r in scan_licenses(df, F.col("path"), named).collect()}
    assert {k: r["license"] for k, r in out.items()} == {1: "MIT", 2: "Apache-2.0", 3: "Apache-2.0", 4: "Apache-2.0", 5: None, 6: "Apache-2.0", 7: "GPL-3.0", 8: "GPL-3.0", 9: "CC-BY-NC-4.0", 10: None}
    assert out[2]["from_path"] == "p" and out[8]["from_path"] == "p/a/b/c" and out[3]["line"] == 0
    assert scan_licenses(df.limit(0), F.col("path")).count() == 0
    assert scan_licenses(df.union(df), F.col("path"), named).count() == 20


@pytest.mark.parametrize("most", [1, 3])
def test_inheritance_over_a_whole_table(spark, most):
    """Every document of a table in a tree of its own, beside a walk up the tree for each file."""
    doc = F.col("doc_id")
    step = lambda k: F.concat(F.lit("d"), F.pmod(F.xxhash64(doc, F.lit(k)), F.lit(3)).cast("string"))
    depth = F.pmod(F.xxhash64(doc), F.lit(5))
    tree = F.concat_ws("/", *[F.when(depth > k, step(k)) for k in range(4)], F.concat(doc.cast("string"), F.lit(".txt")))
    path = F.when(doc % 50 != 7, tree)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = scan_licenses(docs, path, doc % 4 < most).collect()
    assert len(out) == docs.count()
    offers = defaultdict(list)
    for r in out:
        if r["path"] is not None and r["own_license"] is not None and r["doc_id"] % 4 < most:
            offers["/".join(r["path"].split("/")[:-1])].append((-r["score"], r["path"], r["own_license"]))
    inherited = 0
    for r in out:
        want = (r["own_license"], None)
        if r["own_license"] is None and r["path"] is not None:
            parts = r["path"].split("/")[:-1]
            for k in range(len(parts), -1, -1):
                if here := offers.get("/".join(parts[:k])):
                    want = (min(here)[2], "/".join(parts[:k]))
                    inherited += 1
                    break
        assert (r["license"], r["from_path"]) == want, r
    assert inherited > 300 and len({r["from_path"] for r in out}) > 5


def test_licence_windows_same_as_plain(spark):
    data = [(i, t) for i, t, *_ in ODD if i is not None] + [(100 + i, "some words\n" + t + "\nand more") for i, t in enumerate(TEMPLATES.values())]
    df = spark.createDataFrame(data, "doc_id long, text string")
    files = len(data)
    df_counts = Counter(t for _, text in data for t in set(terms((text or "").encode())))
    matcher = Matcher(TEMPLATES, files, df_counts)
    got = {r["doc_id"]: (r["own_license"], r["score"]) for r in scan_licenses(df, F.col("doc_id").cast("string")).collect()}
    for i, text in data:
        lines, best = (text or "").encode().split(b"\n"), (None, None)
        for w in (1, 2, 3):
            for k in range(len(lines) - w + 1):
                cos = matcher.cosine(terms(b"\n".join(lines[k : k + w])))
                if cos.max() >= 0.8 and cos.max() > (best[1] or 0) + 1e-12:
                    best = (matcher.names[int(cos.argmax())], float(cos.max()))
        assert got[i][0] == best[0] and (best[1] is None or abs(got[i][1] - best[1]) < 1e-6)


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = op9_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id")
    assert out.where("lang_pred = lang").count() / out.count() > 0.98


def test_language_odd_rows(spark, empty):
    out = {r["doc_id"]: r for r in langid.identify_languages(frame(spark, ODD), with_spans=True).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1, 2, 3, 17, 18)) and out[15]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[1]["spans"] == []
    assert langid.identify_languages(empty).count() == 0
    none = spark.createDataFrame([(1, "text", None, "a")], "doc_id long, text string, lang string, source string")
    assert langid.identify_languages(none).first()["lang_pred"] == "und"


def test_viterbi_same_as_plain():
    rnd = np.random.default_rng(3)
    bounds = np.array([0, 0, 1, 130, 131, 700])
    scores = rnd.normal(size=(700, 3)) * 5
    got = langid.viterbi(scores, bounds, 4.0)
    for a, b in zip(bounds, bounds[1:]):
        value, back = None, []
        for t in range(a, b):
            if value is None:
                value = scores[t].copy()
                continue
            step = value[:, None] - 4.0 * (1 - np.eye(3))
            back.append(step.argmax(axis=0))
            value = step.max(axis=0) + scores[t]
        if value is not None:
            total = sum(scores[t][got[t]] for t in range(a, b)) - 4.0 * np.count_nonzero(np.diff(got[a:b]))
            assert abs(total - value.max()) < 1e-9


def test_mixed_language_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_languages(docs, F.lit(True))
    en, fr = (docs.where(f"lang = '{x}' and length(text) between 1500 and 4000").orderBy("doc_id").first()["text"] for x in ("en", "fr"))
    both = spark.createDataFrame([(1, en + " " + fr)], "doc_id long, text string")
    r = langid.predict_languages(both, model, with_spans=True).first()
    assert [s["lang"] for s in r["spans"]] == ["en", "fr"] and abs(r["spans"][0]["n_words"] - len(en.split())) <= 3


def test_script_narrows():
    import pyarrow as pa

    in_script = np.zeros((len(langid.SCRIPTS), 2), bool)
    in_script[langid.SCRIPTS.index("latin"), 0] = in_script[langid.SCRIPTS.index("cyrillic"), 1] = True
    model = langid.LanguageModel(("xx", "yy"), np.zeros((1 << langid.GRAM_BITS, 2)), in_script, 1.0)
    words, labels, letters = langid.label_texts(pa.array(["abc мир 12 中"]), model)
    assert labels.tolist()[:2] == [0, 1] and letters.tolist() == [3, 3, 0, 1]


@pytest.mark.parametrize("name", ["mean_word_chars", "symbols_per_word"])
def test_features_are_columns(spark, name):
    df = quality.text_statistics(frame(spark, ODD))
    assert df.select(quality.features()[name].alias("x")).where("x is null").count() == 0


def test_quality_verdict_same_as_plain(spark):
    """The learned list, applied by plain Python to plain counts."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = {r["doc_id"]: r for r in quality.judge_quality(docs, labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = {d: dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), plain_counts(t))) for d, t in texts.items()}
    failed = {d: c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"] for d, c in counts.items()}
    assert all((r["n_words"], r["n_repeat_words"], r["base_failed"]) == (counts[d]["n_words"], counts[d]["n_repeat_words"], failed[d]) for d, r in out.items())
    # Features by Spark over the plain counts; the list learned anew from the labelled ones and walked rule by rule.
    full = docs.select("doc_id").join(quality.text_statistics(docs), "doc_id").select("doc_id", *[c.alias(k) for k, c in quality.features().items()]).collect()
    x = {r["doc_id"]: r.asDict() for r in full}
    label = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    train = sorted((d for d in label if d in x and not failed[d]), key=lambda d: hashlib.md5(str(d).encode()).hexdigest())
    names = sorted(quality.features())
    rules = quality.learn_rules({k: np.array([x[d][k] for d in train]) for k in names}, np.array([label[d] == 0 for d in train]))
    assert rules

    def first(d):
        for i, rule in enumerate(rules, 1):
            if all((x[d][c.feature] >= c.threshold) if c.above else (x[d][c.feature] <= c.threshold) for c in rule):
                return i
        return 0

    assert all(r["rule"] == first(d) and r["kept"] == (not failed[d] and not first(d)) for d, r in out.items())
    known = [d for d in label if not failed[d]]
    rejected = [d for d in known if not out[d]["kept"]]
    assert rejected and sum(label[d] == 0 for d in rejected) >= 0.9 * len(rejected)


def plain_language(text, model):
    """Label by label: gram scores of every word, then Viterbi over single words."""
    words = WORD.findall(text.lower())
    table = langid.WordTable(__import__("pyarrow").array([w.encode() for w in words], "binary"))
    scores = table.scores(model)
    best, back = list(scores[0]), []
    for row in scores[1:]:
        top = int(np.argmax(best))
        step = [top if best[top] - model.switch > b else i for i, b in enumerate(best)]
        back.append(step)
        best = [max(b, best[top] - model.switch) + s for b, s in zip(best, row)]
    state, labels = int(np.argmax(best)), []
    for step in [*reversed(back), None]:
        labels.append(state)
        state = step[state] if step else state
    mass = np.bincount(labels[::-1], weights=table.letters, minlength=len(model.languages))
    return model.languages[int(mass.argmax())], mass.max() / max(mass.sum(), 1)


def test_language_same_as_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_languages(docs, ~langid.held_out(F.col("doc_id")))
    out = {r["doc_id"]: r for r in op9_language_id(spark, SF).collect()}
    for r in docs.collect():
        if r["text"] and any(c.isalpha() for c in r["text"]) and len(r["text"]) < 5000:
            want, score = plain_language(r["text"], model)
            assert out[r["doc_id"]]["lang_pred"] == want and abs(out[r["doc_id"]]["score"] - score) < 1e-9
