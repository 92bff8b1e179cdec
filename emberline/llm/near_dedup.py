"""Near-duplicate detection by MinHash signatures and an inverted join over their coordinates.

1. Texts with the same shingle set are one class and go on as one node.
2. A node is posted under its (coordinate, value) pairs. Two signatures that agree in at least
   ``agree`` of ``coordinates`` places share one of the ``coordinates - agree + 1`` rarest posts
   of either, so only those are kept (the prefix), and of them only posts that somebody else has.
3. Posts are merged: the collisions of members that are not in one component yet are counted over
   the whole signatures, those of members that already are get skipped, and a post gives a
   spanning forest of its matches. Components of these are families: every pair of signatures
   that match is in one.
4. Texts meet once more, by family, and are compared on their full shingle sets; again members
   that are already linked are skipped.

No step writes the pairs of a group: posts and families cost rows in proportion to their members
(``closing`` says how the large ones are dealt out). A pair of sets with similarity 0.8 agrees in
fewer than 32 of 64 places with a probability of about 1e-8; everything else is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import Words, first_of_runs, mix64, slices, utf8
from .closing import close_groups, forest, roots, whole_groups
from .runtime import cut_table, forget_kept, small_batches

_RANDOM = np.random.default_rng(7)
_TIMES = (_RANDOM.integers(0, 2**63, 1024, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_PLUS = _RANDOM.integers(0, 2**63, 1024, dtype=np.uint64)
#: Shingles whose hashes are multiplied at once: their temporaries stay in a core's cache.
_BLOCK = 1 << 15
#: Groups up to this size are compared by shifting sorted rows, larger ones on their own.
_SMALL = 16


def hashed_shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of the distinct ``width``-word shingles, sorted; a shorter text is one shingle."""
    distinct = words.distinct if len(words) else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[words.ids] if distinct else np.zeros(0, np.uint64)
    texts = words.texts
    sizes = np.diff(words.bounds)
    n = len(h)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, n)):
        # Past the end of a text nothing is added, so a short text is the sequence of its words.
        inside = np.zeros(n, dtype=bool)
        inside[: n - k] = texts[: n - k] == texts[k:]
        nxt = np.zeros(n, dtype=np.uint64)
        nxt[: n - k] = h[k:]
        key = np.where(inside, mix64(key * np.uint64(0x9E3779B97F4A7C15) + nxt + np.uint64(k + 1)), key)
    place = np.arange(n) - words.bounds[:-1][texts]
    whole = place <= np.maximum(sizes[texts] - width, 0)
    key, texts = key[whole], texts[whole]
    order = np.lexsort((key, texts))
    key, texts = key[order], texts[order]
    first = first_of_runs(key) | first_of_runs(texts)
    return texts[first], key[first]


def minhash(keys: np.ndarray, begins: np.ndarray, coordinates: int) -> np.ndarray:
    """One row of ``coordinates`` 32-bit minima for each text; the keys of text i begin at ``begins[i]``."""
    sig = np.empty((len(begins), coordinates), dtype=np.uint32)
    ends = np.append(begins[1:], len(keys))
    at = 0
    while at < len(begins):
        stop = max(at + 1, int(np.searchsorted(ends, begins[at] + _BLOCK, side="right")))
        own, starts = keys[begins[at] : ends[stop - 1]], begins[at:stop] - begins[at]
        hashed = np.empty_like(own)
        for m in range(coordinates):
            np.multiply(own, _TIMES[m], out=hashed)
            hashed += _PLUS[m]
            sig[at:stop, m] = np.minimum.reduceat(hashed, starts) >> np.uint64(32)
        at = stop
    return sig


def _signatures(width: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            for part in slices(batch, "text"):
                texts, keys = hashed_shingles(Words(*utf8(part.column("text")), lower=True), width)
                n = np.bincount(texts, minlength=part.num_rows)
                have = np.flatnonzero(n)
                begins = np.searchsorted(texts, have)
                sig = minhash(keys, begins, coordinates)
                hi, lo = np.zeros(part.num_rows, np.uint64), np.zeros(part.num_rows, np.uint64)
                if len(have):
                    hi[have] = np.add.reduceat(mix64(keys), begins)
                    lo[have] = np.add.reduceat(mix64(keys ^ np.uint64(0x5851F42D4C957F2D)), begins)
                ends = np.zeros(part.num_rows + 1, dtype=np.int32)
                np.cumsum(n > 0, out=ends[1:])
                low = np.ascontiguousarray((sig & np.uint32(255)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_hash"),
                        pa.array(n.astype(np.int64)),
                        pa.array(hi.view(np.int64)),
                        pa.array(lo.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends * coordinates), pa.array(sig.reshape(-1).view(np.int32))),
                        pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends * coordinates), pa.py_buffer(low)]),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "hi", "lo", "sig", "low"],
                )

    return run


def _neighbours(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of two rows of the same small group, for each distance; ``group`` is sorted."""
    for d in range(1, min(_SMALL, len(group))):
        x = np.flatnonzero(group[d:] == group[:-d])
        if not len(x):
            return
        yield x, x + d


def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, sizes of the runs of sorted ``keys``; places of those in small runs)."""
    starts = np.flatnonzero(first_of_runs(keys))
    sizes = np.diff(np.append(starts, len(keys)))
    return starts, sizes, np.flatnonzero(np.repeat((sizes > 1) & (sizes <= _SMALL), sizes))


def _matches(agree: int, percent: int, coordinates: int):
    """Signatures that agree in ``agree`` places, of members of a post; of a coordinate its lowest byte is compared."""

    def alike(sig: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        sized = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
        out = np.zeros(len(x), dtype=bool)
        out[sized] = (sig[x[sized]] == sig[y[sized]]).sum(1) >= agree
        return out

    def large(sig: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = len(n)
        a, b = [], []
        label, done, turn = np.zeros(m, np.int64), np.zeros(m, dtype=bool), np.zeros(1, np.int64)
        while len(turn):
            counted = np.zeros((len(turn), m), dtype=np.uint16)
            for k in range(coordinates):
                counted += sig[turn, k][:, None] == sig[:, k][None, :]
            ok = (counted >= agree) & (100 * np.minimum(n[turn][:, None], n[None, :]) >= percent * np.maximum(n[turn][:, None], n[None, :]))
            x, y = np.nonzero(ok)
            a.append(turn[x])
            b.append(y)
            done[turn] = True
            # A component needs no more turns if all members of the others have had theirs.
            label = roots(m, np.concatenate(a), np.concatenate(b))
            main = np.bincount(label, minlength=m).argmax()
            turn = np.flatnonzero(~done & (label != main))[:64]
        rest = np.flatnonzero(label != np.arange(m))
        return rest, label[rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "task", 20_000):
            tasks, nodes, n = (rows.column(c).to_numpy() for c in ("task", "node", "n"))
            low = rows.column("low").combine_chunks()
            low = low.chunk(0) if isinstance(low, pa.ChunkedArray) else low
            sig = np.frombuffer(b"".join(low.to_pylist()), np.uint8).reshape(-1, coordinates)
            a, b = [], []
            starts, sizes, small = _split(tasks)
            for x, y in _neighbours(tasks[small]):
                x, y = small[x], small[y]
                ok = alike(sig, n, x, y)
                a.append(x[ok])
                b.append(y[ok])
            for start, size in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist()):
                x, y = large(np.ascontiguousarray(sig[start : start + size]), n[start : start + size])
                a.append(start + x)
                b.append(start + y)
            if a:
                yield forest(nodes, np.concatenate(a), np.concatenate(b))

    return run


def similar(sizes_a: np.ndarray, sizes_b: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    return (common > 0) & (100 * common >= percent * (sizes_a + sizes_b - common))


def exact_shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, number) of the distinct shingles, sorted; numbers stand for word sequences without hashing."""
    texts, ids = words.texts, words.ids if len(words) else np.zeros(0, np.int64)
    n, sizes = len(ids), np.diff(words.bounds)
    key = ids + 1
    for k in range(1, width):
        nxt = np.zeros(n, dtype=np.int64)
        if n > k:
            nxt[: n - k] = np.where(texts[: n - k] == texts[k:], ids[k:] + 1, 0)
        _, key = np.unique(key * (int(ids.max(initial=0)) + 2) + nxt, return_inverse=True)
    place = np.arange(n) - words.bounds[:-1][texts]
    whole = place <= np.maximum(sizes[texts] - width, 0)
    key, texts = key[whole].astype(np.int64), texts[whole]
    combined = np.unique(texts * (int(key.max(initial=0)) + 1) + key)
    return combined // (int(key.max(initial=0)) + 1), combined % (int(key.max(initial=0)) + 1)


def _linked(tasks: np.ndarray, texts: pa.Array, width: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked texts of the same task; ``tasks`` is sorted."""
    of, keys = exact_shingles(Words(*utf8(texts), lower=True), width)
    count = np.bincount(of, minlength=len(tasks))
    starts, sizes, _ = _split(tasks)
    of_group = np.repeat(np.arange(len(starts)), sizes)
    a, b = [], []
    few = sizes[of_group[of]] <= _SMALL
    if few.any():
        own, key = of[few], keys[few]
        code = of_group[own] * (int(key.max()) + 1) + key
        order = np.argsort(code, kind="stable")
        own, code = own[order], code[order]
        pairs = np.zeros(len(tasks) * _SMALL, dtype=np.int64)
        for x, y in _neighbours(code):
            pairs += np.bincount(own[x] * _SMALL + own[y] - own[x], minlength=len(pairs))
        hit = np.flatnonzero(pairs)
        x, y = hit // _SMALL, hit // _SMALL + hit % _SMALL
        ok = similar(count[x], count[y], pairs[hit], percent)
        a.append(x[ok])
        b.append(y[ok])
    for start, size in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist()):
        lo, hi = np.searchsorted(of, [start, start + size])
        own, (_, key, often) = of[lo:hi] - start, np.unique(keys[lo:hi], return_inverse=True, return_counts=True)
        shared = np.flatnonzero(often[key] > 1)
        _, key = np.unique(key[shared], return_inverse=True)
        own, order = own[shared], np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        common = np.zeros((size, size), dtype=np.float32)
        for first in range(0, int(key.max(initial=-1)) + 1, 4096):
            s, e = np.searchsorted(key, [first, first + 4096])
            held = np.zeros((size, 4096), dtype=np.float32)
            held[own[s:e], key[s:e] - first] = 1
            common += held @ held.T
        n = count[start : start + size]
        x, y = np.nonzero(similar(n[:, None], n[None, :], common, percent))
        label = roots(size, x, y)
        rest = np.flatnonzero(label != np.arange(size))
        a.append(start + rest)
        b.append(start + label[rest])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _links(width: int, percent: int, limit: int = 4 << 20):
    """Links between texts of the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "task", 256):
            tasks, nodes = rows.column("task").to_numpy(), rows.column("node").to_numpy()
            texts = rows.column("text").combine_chunks()
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            ends = np.append(np.flatnonzero(first_of_runs(tasks))[1:], len(tasks))
            at, base = 0, 0
            while at < len(tasks):
                fit = ends[(ends > at) & (size[ends - 1] <= base + limit)]
                stop = int(fit[-1]) if len(fit) else int(ends[ends > at][0])
                a, b = _linked(tasks[at:stop], texts.slice(at, stop - at), width, percent)
                if len(a):
                    yield forest(nodes[at:stop], a, b)
                at, base = stop, int(size[stop - 1])

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    coordinates: int = 64,
    agree: int = 32,
    post_rows: int = 4096,
    family_rows: int = 512,
    family_shingles: int = 200_000,
    with_hash: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept`` (and ``text_hash``, Spark's xxhash64 of the text).

    A text's set has its distinct ``width``-word shingles (A-Z lower-cased; with fewer words the
    whole sequence). Sets are linked if 100 * common >= ``percent`` * union; ``component_id`` is
    the smallest id that links reach. Defined cases: a null text or one without words has an
    empty set and links with nothing; a null id never stands for a component; rows that repeat
    an id are each judged by their own set, and all of those whose component the id stands for
    are kept; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    schema = "doc_id long, text_hash long, n_shingles long, hi long, lo long, sig array<int>, low binary"
    rows = cut_table(base.mapInArrow(_signatures(width, coordinates), schema))
    sets = ["hi", "lo", "n_shingles"]
    first = F.min(F.struct("doc_id", "text_hash", "sig", "low")).alias("own")
    classes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*sets).agg(first).select(*sets, "own.*")
    classes = cut_table(classes.withColumn("node", F.monotonically_increasing_id()))

    posts = classes.select("node", F.posexplode("sig").alias("at", "value")).select("node", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long")).alias("grp"))
    shared = posts.groupBy("grp").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    by_node = posts.join(shared, "grp").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "grp"))).alias("common"))
    # Posts that nobody shares are the rarest and take their places in the prefix first. With one place more than the
    # prefix, two signatures that match share two posts: the second tells who may match inside a large group.
    taken = F.slice("common", F.lit(1), F.greatest(F.lit(0), F.lit(2 - agree) + F.size("common")))
    keys = cut_table(by_node.select("node", F.transform(taken, lambda p: p["grp"]).alias("keys")).where(F.size("keys") > 1))
    prefix = keys.select("node", F.explode(F.slice("keys", F.lit(1), F.size("keys") - 1)).alias("grp"))
    members = classes.select("node", F.col("n_shingles").alias("n"), "low").join(prefix, "node").select("node", "n", "low", "grp", F.lit(1).alias("weight"))
    families = close_groups(cut_table(members), keys, ["n", "low"], _matches(agree, percent, coordinates), post_rows, post_rows)

    out = rows.select("doc_id", "text_hash", *sets)
    component = F.col("own_id")
    of_class = classes.select(*sets, "node", F.col("doc_id").alias("own_id"))
    links = None
    if families is not None:
        # Only texts of families are looked at again; rows alike in id and text stand for one node, which links to itself.
        wanted = families.join(classes.select("node", "n_shingles", F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")), "node")
        text = base.join(wanted, (F.col("doc_id") == F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")))
        text = text.select(F.col("label").alias("grp"), "node", F.col("n_shingles").alias("weight"), "text")
        links = close_groups(cut_table(text), keys, ["text"], _links(width, percent), family_rows, family_shingles)
    if links is not None:
        smallest = links.join(of_class.select("node", "own_id"), "node").groupBy("label").agg(F.min("own_id").alias("reached"))
        of_class = of_class.join(links.join(smallest, "label").select("node", "reached"), "node", "left")
        component = F.coalesce("reached", "own_id")
    out = out.join(of_class.select(*sets, component.alias("component_id")), sets, "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *(["text_hash"] if with_hash else []))
