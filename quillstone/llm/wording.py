"""Ids of texts as words for the range coder: parts that a frame repeats are one symbol each.

A frame's commonest parts make its book, commonest first, and the range coder's contexts and mixes
work on whole parts. A part that isn't in the book has symbol 0 and its ids follow apart,
deflated like the book.

Layout, little-endian: "QWD2", uint32 crc32 of the four tables, four uint32 lengths, then the deflated tables: the sizes
(uint32) and ids (uint16) of the book, and those of the parts that aren't in it; then the coder's blocks, each with its own checksum.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

from quillstone.llm import rangecoder

MAGIC = b"QWD2"
#: Parts that are spread at once.
TOGETHER = 1 << 16


def spread(flat: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs flat[start[n] : start[n] + size[n]] for n in `at`, in a row."""
    out, to = np.empty(int(size[at].sum()), flat.dtype), 0
    for some in range(0, len(at), TOGETHER):
        n = at[some : some + TOGETHER]
        k = size[n]
        ends = np.cumsum(k)
        out[to : to + ends[-1]] = flat[np.repeat(start[n] - (ends - k), k) + np.arange(ends[-1])]
        to += int(ends[-1])
    return out


def joined(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same for runs that lie in `flat` one after the other; Arrow copies each whole."""
    ends = np.cumsum(np.r_[0, size]) * flat.itemsize
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])
    some = [at[k : k + TOGETHER] for k in range(0, len(at), TOGETHER)]
    lengths = [int(size[n].sum()) for n in some]
    out, to = np.empty(sum(lengths), flat.dtype), 0
    for n, k in zip(some, lengths):
        out[to : to + k] = np.frombuffer(runs.take(pa.array(n)).buffers()[2] or b"", flat.dtype, k)
        to += k
    return out


def pack(at: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray, end_id: int) -> bytes:
    """The ids of the parts `at`, where -1 is the end id alone; ValueError if an id is 65536 or more."""
    start, size = np.r_[start, len(flat)], np.r_[size, 1]  # -1 is the last one
    flat = np.r_[flat, end_id]
    if len(at) and (flat.max() >= rangecoder.IDS or flat.min() < 0):
        raise ValueError(f"ids must be from 0 to {rangecoder.IDS - 1}")
    # a frame has millions of parts: numpy widens those of a portion only
    some = [slice(k, k + TOGETHER) for k in range(0, len(at), TOGETHER)]
    count = np.zeros(len(size), np.int64)
    for k in some:
        seen = np.bincount(at[k] + 1)
        count[: len(seen) - 1] += seen[1:]
        count[-1] += seen[0]
    book = np.flatnonzero(count > 1)
    book = book[np.argsort(-count[book], kind="stable")][: rangecoder.IDS - 1]
    symbol = np.zeros(len(size), np.uint16)
    symbol[book] = np.arange(1, len(book) + 1)
    coded = np.empty(len(at), np.uint16)
    for k in some:
        coded[k] = symbol[at[k]]
    rare = at[coded == 0]
    tables = [x for n in (book, rare) for x in (size[n].astype("<u4").tobytes(), spread(flat, start, size, n).astype("<u2").tobytes())]
    crc = zlib.crc32(b"".join(tables))
    tables = [zlib.compress(x, 1) for x in tables]
    return MAGIC + struct.pack("<5I", crc, *map(len, tables)) + b"".join(tables) + rangecoder.pack(coded)


def unpack(data: bytes) -> np.ndarray:
    """The ids of `pack`; ValueError where a checksum fails."""
    if data[:4] != MAGIC:
        raise ValueError("no frame")
    crc, *lengths = struct.unpack_from("<5I", data, 4)
    cuts = np.cumsum([24, *lengths]).tolist()
    try:
        sizes, ids, rare_sizes, rare_ids = (zlib.decompress(data[a:b]) for a, b in zip(cuts, cuts[1:]))
    except zlib.error as e:
        raise ValueError("a frame's table is damaged") from e
    if zlib.crc32(b"".join((sizes, ids, rare_sizes, rare_ids))) != crc:
        raise ValueError("a frame's checksum differs")
    n_book = len(sizes) // 4
    size = np.frombuffer(sizes + rare_sizes, "<u4").astype(np.int64)
    flat = np.frombuffer(ids + rare_ids, "<u2")
    symbol = rangecoder.unpack(data[cuts[-1] :])
    rare = symbol == 0
    at = symbol.astype(np.int32)
    at -= 1
    at[rare] = np.arange(n_book, n_book + np.count_nonzero(rare), dtype=np.int32)
    del symbol, rare
    if len(at) and at.max() >= len(size) or len(flat) != size.sum():
        raise ValueError("a frame's tables differ from its blocks")
    return joined(flat.astype("<u4"), size, at)
