"""Language identification of mixed-language text.

Training counts hashed character n-grams per language on a bounded sample of labelled documents.
Prediction scores every distinct word once: the script of its letters narrows the languages to
those that were seen with that script, and the n-gram log-likelihoods give a score for each.
Viterbi over the words, with a penalty for each switch, then labels spans. It runs as max-plus
products of word blocks, so all texts of a slice advance together and a long text takes no
longer than its words: blocks first, then the chain of blocks, then back through the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .arrow_text import Words, mix64, slices, utf8
from .runtime import forget_kept, small_batches

#: First code points of script ranges and their names; fixed values of the Unicode block layout.
SCRIPT_STARTS = (0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3130, 0x3190, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000)
SCRIPT_NAMES = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "devanagari", "other", "thai", "other", "georgian", "hangul", "other", "latin", "greek", "other", "kana", "other", "hangul", "other", "han", "other", "hangul", "other", "han", "other", "han")
SCRIPTS = tuple(dict.fromkeys(SCRIPT_NAMES))
_SCRIPT_ID = np.array([SCRIPTS.index(s) for s in SCRIPT_NAMES], dtype=np.int8)
GRAM_BITS = 16
GRAMS = (1, 2, 3, 4)
BLOCK = 128
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """``scores``: log-probability by gram bucket and language; ``in_script``: languages by script."""

    languages: tuple[str, ...]
    scores: np.ndarray
    in_script: np.ndarray
    switch: float


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


class WordTable:
    """The distinct words of a slice: their letters, script and gram buckets."""

    def __init__(self, distinct: pa.Array):
        distinct = distinct.cast(pa.large_string()) if len(distinct) else pa.array([], pa.large_string())
        text = "".join(distinct.to_pylist())
        sizes = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        self.n = len(sizes)
        self.word_of = np.repeat(np.arange(self.n), sizes)
        letter = ((points >= 97) & (points <= 122)) | ((points >= 65) & (points <= 90))
        odd = points >= 128
        if odd.any():
            values, where = np.unique(points[odd], return_inverse=True)
            letter[odd] = np.array([chr(v).isalpha() for v in values.tolist()])[where]
        self.letters = np.bincount(self.word_of[letter], minlength=self.n)
        script = _SCRIPT_ID[np.searchsorted(SCRIPT_STARTS, points[letter], side="right") - 1]
        self.script = np.full(self.n, -1, dtype=np.int64)
        np.maximum.at(self.script, self.word_of[letter], script)
        # Words of letters only, each between two borders (code point 1): grams never cross words.
        kept, of = points[letter], self.word_of[letter]
        counts = self.letters + 2
        begins = np.cumsum(counts) - counts
        line = np.ones(int(counts.sum()), dtype=np.uint64)
        within = np.arange(len(kept)) - (np.cumsum(self.letters) - self.letters)[of]
        line[begins[of] + 1 + within] = kept
        owner = np.repeat(np.arange(self.n), counts)
        has = self.letters[owner] > 0
        line, owner = line[has], owner[has]
        grams, owners = [], []
        key = np.zeros(len(line), dtype=np.uint64)
        for g in GRAMS:
            m = len(line) - g + 1
            if m <= 0:
                break
            key = mix64(key[:m] * np.uint64(0x9E3779B97F4A7C15) + line[g - 1 :] + np.uint64(g))
            ok = owner[:m] == owner[g - 1 :]
            if g == 1:
                ok = ok & (line != 1)
            grams.append((key[ok] >> np.uint64(64 - GRAM_BITS)).astype(np.int64))
            owners.append(owner[:m][ok])
        self.grams = np.concatenate(grams) if grams else np.zeros(0, np.int64)
        self.owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)

    def scores(self, model: LanguageModel) -> np.ndarray:
        """Score of every word in every language; 0 in all for a word without letters or of no known script."""
        out = np.empty((self.n, len(model.languages)))
        for i in range(len(model.languages)):
            out[:, i] = np.bincount(self.owners, weights=model.scores[self.grams, i], minlength=self.n)
        known = (self.script >= 0) & model.in_script[np.maximum(self.script, 0)].any(axis=1)
        allowed = model.in_script[np.maximum(self.script, 0)]
        out = np.where(allowed, out, -1e6)
        out[~known] = 0.0
        return out - out.max(axis=1, keepdims=True) if self.n else out


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word; ``scores`` by word and language, texts between ``bounds``."""
    n_words, n_lang = scores.shape
    labels = np.zeros(n_words, dtype=np.int64)
    if not n_words:
        return labels
    sizes = np.diff(bounds)
    blocks_of = -(-sizes // BLOCK)
    first_block = np.cumsum(blocks_of) - blocks_of
    n_blocks = int(blocks_of.sum())
    text_of = np.repeat(np.arange(len(sizes)), blocks_of)
    nth = np.arange(n_blocks) - first_block[text_of]
    begin = bounds[:-1][text_of] + nth * BLOCK
    length = np.minimum(BLOCK, bounds[1:][text_of] - begin)
    steps = int(length.max())
    cell = begin[:, None] + np.arange(steps)[None, :]
    real = np.arange(steps)[None, :] < length[:, None]
    s = np.where(real[:, :, None], scores[np.minimum(cell, n_words - 1)], 0.0)
    # Transfer of every block: best score from each language before it to each at its end.
    move = np.full((n_blocks, n_lang, n_lang), -1e18)
    move[:, np.arange(n_lang), np.arange(n_lang)] = 0.0
    for t in range(steps):
        move = np.maximum(move, move.max(axis=2, keepdims=True) - switch * real[:, t, None, None] - 1e18 * ~real[:, t, None, None]) + s[:, t, None, :]
    # Chain of blocks, all texts at once: the language before each block and at its end.
    most = int(blocks_of.max())
    value = np.zeros((len(sizes), n_lang))
    came = np.zeros((n_blocks, n_lang), dtype=np.int64)
    for b in range(most):
        live = np.flatnonzero(blocks_of > b)
        k = first_block[live] + b
        through = value[live][:, :, None] + move[k]
        came[k] = through.argmax(axis=1)
        value[live] = through.max(axis=1)
    exits, entries = np.zeros(n_blocks, dtype=np.int64), np.zeros(n_blocks, dtype=np.int64)
    state = value.argmax(axis=1)
    for b in range(most - 1, -1, -1):
        live = np.flatnonzero(blocks_of > b)
        k = first_block[live] + b
        exits[k] = state[live]
        state[live] = entries[k] = came[k, state[live]]
    # Forward again from the known entry, with back pointers, then back from the known exit.
    v = np.full((n_blocks, n_lang), -1e18)
    v[np.arange(n_blocks), entries] = 0.0
    back = np.zeros((steps, n_blocks, n_lang), dtype=np.min_scalar_type(-max(n_lang, 1)))
    for t in range(steps):
        best = v.argmax(axis=1)
        jump = v.max(axis=1, keepdims=True) - switch
        moved = (jump > v) & real[:, t, None]
        back[t] = np.where(moved, best[:, None], np.arange(n_lang)[None, :])
        v = np.where(moved, jump, v) + s[:, t]
    state = exits
    for t in range(steps - 1, -1, -1):
        at = np.flatnonzero(real[:, t])
        labels[cell[at, t]] = state[at]
        state = back[t][np.arange(n_blocks), state].astype(np.int64)
    return labels


def viterbi_in_parts(scores: np.ndarray, bounds: np.ndarray, switch: float, cells: int = 1 << 22) -> np.ndarray:
    """``viterbi`` over runs of texts whose blocks have about ``cells`` cells of transfer, or over single longer texts."""
    blocks = np.cumsum(-(-np.diff(bounds) // BLOCK)) * scores.shape[1] ** 2
    parts, at, base = [], 0, 0
    while at < len(bounds) - 1:
        stop = max(at + 1, int(np.searchsorted(blocks, base + cells, side="right")))
        parts.append(viterbi(scores[bounds[at] : bounds[stop]], bounds[at : stop + 1] - bounds[at], switch))
        at, base = stop, int(blocks[stop - 1])
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def label_texts(column: pa.Array, model: LanguageModel) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, language of each word, letters of each word) of the texts of a column."""
    return weighed_texts(column, model)[:3]


def weighed_texts(column: pa.Array, model: LanguageModel) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, language of each word, its letters, its letters of a script that some language has) of the texts of a column."""
    words = Words(*utf8(lowered(column)))
    table = WordTable(words.encoded.dictionary)
    if not len(words):
        none = np.zeros(0, np.int64)
        return words, none, none, none
    ids, letters = words.ids, table.letters
    known = (table.script >= 0) & model.in_script[np.maximum(table.script, 0)].any(axis=1)
    return words, viterbi_in_parts(table.scores(model)[ids], words.bounds, model.switch), letters[ids], np.where(known, letters, 0)[ids]


def fit_languages(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 2000, switch: float = 12.0, smoothing: float = 0.5) -> LanguageModel:
    """A model of the languages of the rows where ``usable`` holds and text and language are there.

    It is fitted on about ``per_language`` documents of each language at most: those whose digest
    is under a threshold set from the language's number of documents.
    """
    small_batches(docs.sparkSession)
    ready = docs.where(usable & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in ready.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(sizes))
    empty = np.zeros((1 << GRAM_BITS, 0))
    if not languages:
        return LanguageModel((), empty, np.zeros((len(SCRIPTS), 0), bool), switch)
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / sizes[lang]))).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 20)) < share * F.lit(float(1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        grams = np.zeros((len(languages), 1 << GRAM_BITS), dtype=np.int64)
        scripts = np.zeros((len(languages), len(SCRIPTS)), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*utf8(lowered(part.column("text"))))
                if not len(words):
                    continue
                table = WordTable(words.encoded.dictionary)
                lang = np.array([languages.index(x) for x in part.column("lang").to_pylist()])[words.texts]
                for i in np.unique(lang):
                    times = np.bincount(words.ids[lang == i], minlength=table.n)
                    grams[i] += np.bincount(table.grams, weights=times[table.owners], minlength=1 << GRAM_BITS).astype(np.int64)
                    ok = table.script >= 0
                    scripts[i] += np.bincount(table.script[ok], weights=times[ok], minlength=len(SCRIPTS)).astype(np.int64)
        for kind, counts in (("gram", grams), ("script", scripts)):
            i, j = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(i)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(counts[i, j])], ["kind", "lang", "at", "n"])

    # At most languages * (2 ** GRAM_BITS + scripts) sums come to the driver.
    sums = ready.where(drawn).select("text", "lang").mapInArrow(count, "kind string, lang int, at int, n long").groupBy("kind", "lang", "at").agg(F.sum("n").alias("n")).toArrow()
    kind, lang, at, n = (sums.column(c).to_numpy() for c in ("kind", "lang", "at", "n"))
    grams = np.full((1 << GRAM_BITS, len(languages)), smoothing)
    is_gram = kind == "gram"
    grams[at[is_gram], lang[is_gram]] += n[is_gram]
    scripts = np.zeros((len(SCRIPTS), len(languages)))
    scripts[at[~is_gram], lang[~is_gram]] = n[~is_gram]
    return LanguageModel(languages, np.log(grams / grams.sum(axis=0)), scripts >= 0.01 * np.maximum(scripts.sum(axis=0), 1), switch)


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` (and ``spans``: language, first word, words) for each row, from its text alone.

    The predicted language labels most letters of the text, ``score`` is its share of them; letters of a
    script that no language was seen with count for none. A null text or one without letters is
    ``und`` with score 0. Columns named in ``carry`` are passed on as a struct ``carried``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "lang_pred", "score", *(["spans"] if with_spans else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        m = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                n, k = part.num_rows, len(m.languages)
                words, labels, letters, known = weighed_texts(part.column("text"), m) if k else (None, None, None, None)
                mass, total = np.zeros((n, max(k, 1))), np.zeros(n)
                if k and len(words):
                    mass = np.bincount(words.texts * k + labels, weights=known, minlength=n * k).reshape(n, k)
                    total = np.bincount(words.texts, weights=letters, minlength=n)
                best = mass.argmax(axis=1)
                pred = [m.languages[b] if t > 0 else UNKNOWN for b, t in zip(best.tolist(), total.tolist())]
                arrays = [part.column("doc_id"), pa.array(pred, pa.string()), pa.array(np.where(total > 0, mass.max(axis=1) / np.maximum(total, 1), 0.0))]
                if with_spans:
                    arrays.append(pa.array([_spans(words, labels, i, m.languages) if k else [] for i in range(n)], span_type))
                yield pa.RecordBatch.from_arrays([*arrays, *[part.column(c) for c in carried]], [*names, *carried])

    small_batches(docs.sparkSession)
    extra = [F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *extra)
    carried = ["carried"] if carry else []
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
    schema = StructType().add("doc_id", "long").add("lang_pred", "string").add("score", "double")
    if with_spans:
        schema = schema.add("spans", ArrayType(StructType().add("lang", "string").add("first_word", "long").add("n_words", "long")))
    if carry:
        schema = schema.add("carried", base.schema["carried"].dataType)
    return base.mapInArrow(run, schema)


def _spans(words: Words, labels: np.ndarray, i: int, languages: tuple[str, ...]) -> list[dict]:
    own = labels[words.bounds[i] : words.bounds[i + 1]]
    at = np.flatnonzero(np.diff(own, prepend=-1))
    ends = np.append(at[1:], len(own))
    return [{"lang": languages[own[a]], "first_word": int(a), "n_words": int(e - a)} for a, e in zip(at, ends)]


def held_out(id_col: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls in the fold that is never trained on."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(folds)) == fold, F.lit(False))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 2000, with_spans: bool = False) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row; learned from rows outside the held-out fold.

    Defined cases: a null text or one without letters is ``und`` with score 0; with nothing to
    learn from, every row is ``und``; rows with a null id are trained on; repeated rows are
    predicted each on its own; an empty table gives no rows; other columns are ignored.
    """
    model = fit_languages(docs, ~held_out(F.col(id_col)), id_col, text_col, lang_col, per_language)
    out = predict_languages(docs, model, id_col, text_col, with_spans)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *out.columns[1:])
