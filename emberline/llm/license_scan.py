"""Licence detection: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

1. One pass counts in how many files each template term occurs; the vocabulary is bounded by the
   templates, so only that many sums come to the driver.
2. Every window of a file's lines, up to ``window`` lines, is compared with every short form. Terms outside the
   templates weigh as unseen ones. A bound that needs only sums per line (what the template
   terms of a window weigh against its other words) leaves few windows for the exact cosine.
3. Whole licence texts, headers and short forms are compared with every window of as many terms as they have,
   wherever lines end. The part of a template's norm that a text's terms can reach bounds each cosine, so few
   texts are searched; there, dot products and norms of all windows are running sums.
4. An SPDX tag states its licence exactly.
5. Files that are licence files set the licence of their directory. A file without a licence of
   its own takes that of its nearest ancestor directory: its ancestors are joined, one equal key
   each, with the directories that have one, and the longest path wins.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import Words, slices, utf8
from .license_texts import known_texts
from .runtime import cut_table, small_batches

#: Short forms by which files state a licence; fixed public wordings.
TEMPLATES: dict[str, str] = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_TERM_BYTE = np.zeros(256, dtype=bool)
_TERM_BYTE[48:58] = _TERM_BYTE[65:91] = _TERM_BYTE[97:123] = _TERM_BYTE[128:] = True


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and non-ASCII bytes, A-Z lower-cased."""
    return _TERM.findall(text.lower())


def version_terms(name: str, words: Mapping[bytes, int]) -> list[bytes]:
    """The numbers of a licence's version that a header or notice of it holds; a trailing 0 may be left out.

    A whole text needs none: other versions differ by more than their number.
    """
    return [v for v in re.findall(rb"[0-9]+", name.encode()) if v != b"0" and v in words] if sum(words.values()) < 200 else []


class Matcher:
    """Templates as weighted vectors over their own vocabulary."""

    def __init__(self, templates: Mapping[str, str], files: int, df: Mapping[bytes, int]):
        self.names = sorted(templates)
        counts = [Counter(terms(templates[n].encode())) for n in self.names]
        self.versions = [version_terms(n, c) for n, c in zip(self.names, counts)]
        self.vocabulary = sorted({t for c in counts for t in c})
        self.number = {t: i for i, t in enumerate(self.vocabulary)}
        self.unseen = math.log(1 + max(files, 1))
        self.idf = np.array([math.log((1 + max(files, 1)) / (1 + df.get(t, 0))) + 1e-9 for t in self.vocabulary])
        rows = np.zeros((len(self.names), len(self.vocabulary)))
        for i, c in enumerate(counts):
            for t, k in c.items():
                rows[i, self.number[t]] = k * self.idf[self.number[t]]
        self.rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def cosine(self, words: list[bytes]) -> np.ndarray:
        """The cosine of a window's terms to each template."""
        vector, rest = np.zeros(len(self.vocabulary)), 0.0
        for t, k in Counter(words).items():
            i = self.number.get(t)
            if i is None:
                rest += (k * self.unseen) ** 2
            else:
                vector[i] = k * self.idf[i]
        norm = math.sqrt(float(vector @ vector) + rest)
        return self.rows @ vector / norm if norm else np.zeros(len(self.names))


class TermMatcher:
    """Texts of any length as weighted vectors, for windows that have as many terms as they.

    Weights are 1 + log((1 + files) / (1 + files with the term)): a notice that every file has still counts.
    """

    def __init__(self, texts: Sequence[tuple[str, str]], files: int, df: Mapping[bytes, int]):
        texts = sorted(set(texts))
        counts = [Counter(terms(text.encode())) for _, text in texts]
        self.names = [name for name, _ in texts]
        self.lengths = [sum(c.values()) for c in counts]
        self.vocabulary = sorted({t for c in counts for t in c})
        self.number = {t: i for i, t in enumerate(self.vocabulary)}
        self.unseen = 1 + math.log(1 + max(files, 1))
        self.idf = np.array([1 + math.log((1 + max(files, 1)) / (1 + df.get(t, 0))) for t in self.vocabulary])
        rows = np.zeros((len(texts), len(self.vocabulary)))
        for i, c in enumerate(counts):
            for t, k in c.items():
                rows[i, self.number[t]] = k * self.idf[self.number[t]]
        self.rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
        self.squares = np.ascontiguousarray((self.rows**2).T.astype(np.float32))
        self.versions = [[self.number[v] for v in version_terms(n, c)] for n, c in zip(self.names, counts)]

    def candidates(self, texts: np.ndarray, known: np.ndarray, n: int, threshold: float) -> Iterator[tuple[int, int]]:
        """(text, template): all pairs in which a window can have the cosine.

        It is at most the norm of what the template's vector has on the terms of the text.
        """
        present = np.zeros((n, len(self.vocabulary)), dtype=np.float32)
        present[texts[known >= 0], known[known >= 0]] = 1
        reach = present @ self.squares
        yield from np.argwhere(reach >= threshold**2 - 1e-3).tolist()

    def best(self, template: int, words: np.ndarray, known: np.ndarray) -> tuple[float, int, int]:
        """(cosine, first term, end) of the best window of a text; ``words`` are any numbers of its terms."""
        n = len(words)
        width = min(self.lengths[template], n)
        weight = np.where(known >= 0, self.idf[np.maximum(known, 0)], self.unseen)
        part = np.where(known >= 0, self.rows[template][np.maximum(known, 0)], 0.0)
        # How often a term's word is among the width - 1 terms before it and after it.
        order = np.argsort(words, kind="stable")
        key = words[order] * (n + 1) + order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        at = np.arange(n)
        before = rank - np.searchsorted(key, words * (n + 1) + np.maximum(at - width + 1, 0), side="left")
        after = np.searchsorted(key, words * (n + 1) + np.minimum(at + width - 1, n - 1), side="right") - rank - 1
        gain, loss = weight**2 * (2 * before + 1), weight**2 * (2 * after + 1)
        norm = gain[:width].sum() + np.concatenate([[0.0], np.cumsum(gain[width:] - loss[: n - width])])
        cos = _sums(part * weight, width) / np.sqrt(np.maximum(norm, 1e-12))
        for v in self.versions[template]:
            cos[_sums((known == v).astype(float), width) < 0.5] = -1.0
        k = int(np.argmax(cos))
        inside = np.flatnonzero(part[k : k + width] > 0)
        return float(cos[k]), k + (int(inside[0]) if len(inside) else 0), k + width


#: The share of a file's terms that a licence's window takes in where the file is a licence file by its text.
MOST_OF_A_FILE = 0.5
_SPDX_ID = rb"\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*"
_SPDX = re.compile(rb"SPDX-License-Identifier:[ \t]*(" + _SPDX_ID + rb"(?:[ \t]+(?:OR|AND|WITH)[ \t]+" + _SPDX_ID + rb")*)", re.IGNORECASE)


def spdx_license(expression: str, names: Mapping[str, str]) -> str:
    """The licence of one identifier as templates name it (``names`` by lower case); an expression as it is written."""
    if re.search(r"\s", expression):
        return " ".join(expression.split())
    one = re.sub(r"(?i)(-only|-or-later|\+)$", "", expression.strip("()").rstrip("-."))
    return names.get(one.lower(), one)


def _vocabulary_counts(vocabulary: list[bytes]):
    number = {t: i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, files = np.zeros(len(vocabulary), dtype=np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column("text"))
                found, known = _known_terms(data, offsets, number)
                texts = found.texts[known >= 0]
                pairs = np.unique(texts * len(vocabulary) + known[known >= 0])
                total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
                files += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*range(-1, len(vocabulary))], pa.int32()), pa.array([files, *total.tolist()], pa.int64())], ["term", "n"])

    return run


def _known_terms(data: np.ndarray, offsets: np.ndarray, number: Mapping[bytes, int]) -> tuple[Words, np.ndarray]:
    """The terms of a slice and the vocabulary number, or -1, of each."""
    found = Words(data, offsets, lower=True, member=_TERM_BYTE)
    if not len(found):
        return found, np.zeros(0, np.int64)
    of_distinct = np.fromiter((number.get(t, -1) for t in found.distinct), np.int64)
    return found, of_distinct[found.ids]


def _best_windows(matcher: Matcher, by_terms: TermMatcher, window: int, threshold: float):
    short_of = np.array([matcher.number.get(t, -1) for t in by_terms.vocabulary], dtype=np.int64)
    names = {n.lower(): n for n in (*matcher.names, *by_terms.names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column("text"))
                n = part.num_rows
                raw = data.tobytes()
                breaks = np.flatnonzero(data == 10)
                begins = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
                ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
                per_text = np.diff(np.searchsorted(breaks, offsets)) + 1
                line_text = np.repeat(np.arange(n), per_text)
                found, known_all = _known_terms(data, offsets, by_terms.number)
                known = np.where(known_all >= 0, short_of[np.maximum(known_all, 0)], -1)
                # Only lines that hold a term have starts between their ends; empty lines weigh nothing.
                line = np.searchsorted(begins, found.starts, side="right") - 1
                ok = known >= 0
                weight = np.zeros(len(begins))
                np.add.at(weight, line[ok], matcher.idf[known[ok]])
                other = np.bincount(line[~ok], minlength=len(begins)).astype(float)
                in_line = np.bincount(line, minlength=len(begins))
                lines_with_terms = in_line > 0
                before_line = np.concatenate([[0], np.cumsum(in_line)])
                # Cosine, licence, line, terms of the window.
                best = [(-1.0, "", 0, 0)] * n
                for w in range(1, window + 1):
                    if len(begins) < w:
                        break
                    known_sum, other_sum = _sums(weight, w), _sums(other, w)
                    # |known part| is at most the sum of its weights, |other part| squared at least its words.
                    bound = known_sum / np.sqrt(known_sum**2 + other_sum * matcher.unseen**2 + 1e-30)
                    m = len(begins) - w + 1
                    maybe = (line_text[:m] == line_text[w - 1 :]) & (bound >= threshold) & lines_with_terms[:m] & lines_with_terms[w - 1 :]
                    for i in np.flatnonzero(maybe).tolist():
                        words = terms(raw[begins[i] : ends[i + w - 1]])
                        cos = matcher.cosine(words)
                        cos[[k for k, v in enumerate(matcher.versions) if not set(v) <= set(words)]] = -1.0
                        k = int(np.argmax(cos))
                        t = int(line_text[i])
                        if cos[k] >= threshold and cos[k] > best[t][0] + 1e-12:
                            best[t] = (float(cos[k]), matcher.names[k], i - int(np.searchsorted(line_text, t)), int(before_line[i + w] - before_line[i]))
                if len(found):
                    ids = found.ids
                    for t, k in by_terms.candidates(found.texts, known_all, n, threshold):
                        a, b = found.bounds[t], found.bounds[t + 1]
                        cos, first, end = by_terms.best(k, ids[a:b], known_all[a:b])
                        if cos >= threshold and cos > best[t][0] + 1e-9:
                            best[t] = (cos, by_terms.names[k], int(line[a + first]) - int(np.searchsorted(line_text, t)), end - first)
                    spdx = [i for i, word in enumerate(found.distinct) if word == b"spdx"]
                    for t in np.unique(found.texts[np.isin(ids, spdx)]).tolist():
                        if tag := _SPDX.search(raw, int(offsets[t]), int(offsets[t + 1])):
                            name = spdx_license(tag[1].decode(), names)
                            best[t] = (1.0, name, int(np.searchsorted(begins, tag.start(), side="right")) - 1 - int(np.searchsorted(line_text, t)), 0)
                hit = [b[0] >= 0 for b in best]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("file"),
                        pa.array([b[1] if f else None for b, f in zip(best, hit)], pa.string()),
                        pa.array([b[0] if f else None for b, f in zip(best, hit)], pa.float64()),
                        pa.array([b[2] if f else None for b, f in zip(best, hit)], pa.int64()),
                        pa.array(np.array([b[3] for b in best], dtype=float) / np.maximum(np.diff(found.bounds), 1)),
                    ],
                    ["file", "own_license", "score", "line", "covered"],
                )

    return run


def _sums(values: np.ndarray, width: int) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return np.maximum(total[width:] - total[:-width], 0.0)


def scan_licenses(
    files: DataFrame,
    path: Column,
    is_license_file: Column | None = None,
    text_col: str = "text",
    id_col: str = "doc_id",
    templates: Mapping[str, str] = TEMPLATES,
    texts: Sequence[tuple[str, str]] | None = None,
    window: int = 3,
    threshold: float = 0.8,
) -> DataFrame:
    """One row per file: ``doc_id, path, own_license, score, line, license, from_path``.

    ``own_license`` is what the first SPDX tag says (score 1), otherwise the template with the highest cosine (at
    least ``threshold``; ties: a short form within ``window`` lines before other windows, the shorter window, then
    the earlier line, then the smaller name). ``templates`` are short forms, ``texts`` (licence, text) whole texts,
    headers and notices (default: ``known_texts()``). A version that a template names must be in the window. ``license`` is the file's own or that of
    the nearest ancestor directory with a licence file; ``from_path`` is the directory. A licence
    file is one with a licence for which ``is_license_file`` holds (default: named LICENSE or
    COPYING, or with at least half of its terms in the window of the licence). Of several in one directory the highest score,
    then the smallest path, counts. Defined cases: a null or empty text has no licence; a null
    path inherits nothing; repeated rows are judged each on its own; an empty table gives no
    rows; other columns are ignored.
    """
    small_batches(files.sparkSession)
    base = files.select(F.struct(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), (F.lit(False) if is_license_file is None else F.coalesce(is_license_file, F.lit(False))).alias("named")).alias("file"), F.col(text_col).alias("text"))
    every = [*templates.items(), *(known_texts() if texts is None else texts)]
    probe = TermMatcher(every, 1, {})
    sums = {r["term"]: r["n"] for r in base.select("text").mapInArrow(_vocabulary_counts(probe.vocabulary), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    counts = sums.get(-1, 0), {t: sums.get(i, 0) for i, t in enumerate(probe.vocabulary)}
    scored = base.mapInArrow(_best_windows(Matcher(templates, *counts), TermMatcher(every, *counts), window, threshold), "file struct<doc_id:long,path:string,named:boolean>, own_license string, score double, line long, covered double")
    # A table without texts: three parts of the plan read it, and windows are searched once.
    own = cut_table(scored.select("file.*", "own_license", "score", "line", "covered"))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    default = F.startswith(name, F.lit("license")) | F.startswith(name, F.lit("copying")) | (F.col("covered") >= MOST_OF_A_FILE)
    licence_file = F.col("own_license").isNotNull() & F.col("path").isNotNull() & (default if is_license_file is None else F.col("named"))
    own = own.withColumn("dir", F.when(F.contains("path", F.lit("/")), F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)")).otherwise(F.lit("")))
    dirs = own.where(licence_file).groupBy("dir").agg(F.min_by("own_license", F.struct(-F.round("score", 9), F.col("path"))).alias("dir_license"))
    # Files that share a directory share its ancestors: the join is over directories, not files.
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    up = own.where(F.col("own_license").isNull() & F.col("path").isNotNull()).select("dir").distinct().select(F.col("dir").alias("of"), F.explode(F.array_distinct(ancestors)).alias("dir"))
    nearest = up.join(dirs, "dir").groupBy("of").agg(F.max_by(F.struct(F.col("dir").alias("from_path"), F.col("dir_license")), F.length("dir")).alias("near"))
    # A table, so that the join has plain exchanges and Spark can split the files of a hot directory.
    nearest = cut_table(nearest)
    out = own.join(nearest, (own["dir"] == nearest["of"]) & own["own_license"].isNull() & own["path"].isNotNull(), "left")
    return out.select("doc_id", "path", "own_license", F.round("score", 9).alias("score"), "line", F.coalesce("own_license", "near.dir_license").alias("license"), F.col("near.from_path").alias("from_path"))
