"""Whole licence texts, headers, tags and versions, which are not the lines of the test tables."""

import textwrap
from collections import Counter

import numpy as np

from emberline.llm.license_scan import TermMatcher, scan_licenses
from emberline.llm.license_texts import known_texts
from pyspark.sql import functions as F


def whole(name):
    return dict(t for t in known_texts()[::-1] if len(t[1]) > 500)[name]


def rewrapped(text, width, prefix):
    return "\n".join(prefix + line for line in textwrap.wrap(" ".join(text.split()), width))


def test_licence_files_headers_and_tags(spark):
    """None of these was found, or a wrong version was, when only lines were compared with short forms."""
    code = "\nint main(void) { return 0; }\n" * 30
    texts = {
        "MIT": "Copyright (c) 2019 Some Holder\n\n" + rewrapped(whole("MIT"), 60, ""),
        "BSD-2-Clause": rewrapped("Copyright 2001, 2004 A. Person. All rights reserved. " + whole("BSD-2-Clause"), 50, " * ") + code,
        "BSD-3-Clause": rewrapped(whole("BSD-3-Clause").replace("the copyright holder", "Example Inc"), 50, "# ") + code,
        "ISC": rewrapped(whole("ISC"), 70, ""),
        "GPL-2.0": whole("GPL-2.0").split("END OF TERMS")[0],
        "GPL-3.0": "README\n" + rewrapped(whole("GPL-3.0"), 100, "// "),
        "LGPL-2.1": whole("LGPL-2.1"),
        "MPL-2.0": code + "".join(f"{w}\n" for w in whole("MPL-2.0").split()),
        "Apache-2.0": "some words before it " * 50 + rewrapped(dict(n for n in known_texts() if len(n[1]) < 900)["Apache-2.0"], 30, "") + code,
        "AGPL-3.0": code + '''/* This program is free software: you can redistribute it and/or modify it under
 * the terms of the GNU Affero General Public License as published by the Free
 * Software Foundation, either version 3 of the License, or any later version. */''' + code,
        "CC-BY-SA-3.0": "A long first line of prose, which says that this work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License, and goes on with other things after it.",
    }
    tags = {"GPL-2.0": "// SPDX-License-Identifier: GPL-2.0-or-later\nx", "MIT": "x\n/* spdx-license-identifier: mit */", "MIT OR Apache-2.0": "# SPDX-License-Identifier:  MIT OR Apache-2.0\n", "EUPL-1.2": "SPDX-License-Identifier: EUPL-1.2"}
    none = ["Licensed under the Apache License, Version 1.1.", "The words license, permission, software and warranty alone say nothing.", code]
    want = [*texts.items(), *tags.items(), *((None, t) for t in none)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(want)], "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["own_license"] for r in scan_licenses(df, F.col("doc_id").cast("string")).collect()}
    assert [got[i] for i in range(len(want))] == [n for n, _ in want]


def test_gnu_versions_told_apart(spark):
    names = ["GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GFDL-1.2", "GFDL-1.3", "MPL-1.1"]
    notices = [(n, t) for n, t in known_texts() if n in names]
    df = spark.createDataFrame([(i, "before it\n" + rewrapped(t, 44, "* ") + "\nand after") for i, (_, t) in enumerate(notices)], "doc_id long, text string")
    got = {r["doc_id"]: r["own_license"] for r in scan_licenses(df, F.col("doc_id").cast("string")).collect()}
    assert [got[i] for i in range(len(notices))] == [n for n, _ in notices]


def test_term_windows_same_as_plain():
    rnd = np.random.default_rng(5)
    matcher = TermMatcher([("a", "x y z x q"), ("b", " ".join(f"w{i}" for i in rnd.integers(0, 9, 40)))], 7, {b"x": 3, b"w1": 2})
    for size in (3, 5, 60, 300):
        words = [rnd.choice(["x", "y", "z", "q", "o", *[f"w{i}" for i in range(9)]]).encode() for _ in range(size)]
        distinct = sorted(set(words))
        ids, known = np.array([distinct.index(w) for w in words]), np.array([matcher.number.get(w, -1) for w in words])
        for k in range(2):
            width, best = min(matcher.lengths[k], size), -1.0
            for a in range(size - width + 1):
                vector = {w: n * (matcher.idf[matcher.number[w]] if w in matcher.number else matcher.unseen) for w, n in Counter(words[a : a + width]).items()}
                dot = sum(v * matcher.rows[k, matcher.number[w]] for w, v in vector.items() if w in matcher.number)
                best = max(best, dot / sum(v * v for v in vector.values()) ** 0.5)
            assert abs(matcher.best(k, ids, known)[0] - best) < 1e-9
