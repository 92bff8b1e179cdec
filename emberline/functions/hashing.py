"""Digests that Spark lacks: BLAKE2s as an Arrow UDF, BLAKE3 in plain Python for small driver-side files."""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _blake2s(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else hashlib.blake2s(t.encode()).hexdigest())


def blake2s_hex(text: Column) -> Column:
    return F.pandas_udf(_blake2s, StringType())(text)


def stable_uuid(namespace: str, key: Column) -> Column:
    """The first 128 bits of BLAKE2s over ``namespace::key`` in the form of a UUID."""
    h = blake2s_hex(F.concat(F.lit(f"{namespace}::"), key))
    return F.regexp_replace(F.substring(h, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


# Fixed values of the public BLAKE3 specification.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8
_MASK = 0xFFFFFFFF


def _mix(s: list[int], a: int, b: int, c: int, d: int, x: int, y: int) -> None:
    for word, r1, r2 in ((x, 16, 12), (y, 8, 7)):
        s[a] = (s[a] + s[b] + word) & _MASK
        s[d] ^= s[a]
        s[d] = (s[d] >> r1 | s[d] << (32 - r1)) & _MASK
        s[c] = (s[c] + s[d]) & _MASK
        s[b] ^= s[c]
        s[b] = (s[b] >> r2 | s[b] << (32 - r2)) & _MASK


def _compress(chain: tuple[int, ...], block: bytes, counter: int, length: int, flags: int) -> tuple[int, ...]:
    m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
    s = [*chain, *_IV[:4], counter & _MASK, counter >> 32 & _MASK, length, flags]
    for _ in range(7):
        for i in range(4):
            _mix(s, i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            _mix(s, i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        m = [m[k] for k in _PERMUTATION]
    return tuple([s[i] ^ s[i + 8] for i in range(8)] + [s[i + 8] ^ chain[i] for i in range(8)])


def blake3_hex(data: bytes) -> str:
    """The 256-bit BLAKE3 digest, for rule files and other short input."""

    def chunk(part: bytes, counter: int, root: int) -> tuple[int, ...]:
        chain: tuple[int, ...] = _IV
        blocks = [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
        for i, block in enumerate(blocks):
            last = i == len(blocks) - 1
            flags = (_CHUNK_START if i == 0 else 0) | (_CHUNK_END | root if last else 0)
            chain = _compress(chain[:8], block, counter, len(block), flags)
        return chain

    def tree(part: bytes, counter: int, root: int) -> tuple[int, ...]:
        if len(part) <= 1024:
            return chunk(part, counter, root)
        left = 1024
        while left * 2 < len(part):
            left *= 2
        children = tree(part[:left], counter, 0)[:8] + tree(part[left:], counter + left // 1024, 0)[:8]
        return _compress(_IV, struct.pack("<16I", *children), 0, 64, _PARENT | root)

    return struct.pack("<8I", *tree(data, 0, _ROOT)[:8]).hex()
