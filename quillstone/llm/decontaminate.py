"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import cut, lean

TOKEN = re.compile(r"[^\W_]+")
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 19
#: Where each block of a fingerprint's bits begins. With five blocks an item has 1,811 index rows (with four 10,068).
CUTS = (0, 13, 26, 39, 52, 64)
BLOCKS = len(CUTS) - 1
#: Bits of each of the two filters of item shingles, at least and at most: sixteen a shingle
#: between. A fuller filter lets more windows through, which the later steps judge all the same.
FILTER_BITS, FILTER_MOST = 1 << 22, 1 << 26


class Words(dict):
    """Hash of each word, forgotten beyond `most` words."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)
        return got


def word_hashes(text: str | None, words: Words) -> np.ndarray:
    found = TOKEN.findall((text or "").lower())
    return np.fromiter((words[w] for w in found), np.uint64, len(found))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of k words, or of the whole where it is shorter; none where it is empty."""
    k = min(k, len(words))
    if not k:
        return words
    out = np.full(len(words) - k + 1, k, np.uint64)
    for n in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[n : n + len(out)]
    return _mixed(out)


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if more than half of the shingles, counted with their repeats, set it."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all shingles, each weighing as often as it occurs."""
    keys, pos = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(pos[: len(a)], minlength=len(keys)), np.bincount(pos[len(a) :], minlength=len(keys))
    return float(np.minimum(x, y).sum() / max(1, np.maximum(x, y).sum()))


@dataclass
class Filters:
    """Bit sets of all item shingles and of those by item size, and the sizes that occur."""

    bits: int
    any_size: np.ndarray
    by_size: np.ndarray
    sizes: list[int]

    def knows(self, hashes: np.ndarray) -> np.ndarray:
        return _has(self.any_size, hashes & np.uint64(self.bits - 1))

    def knows_sized(self, hashes: np.ndarray, size: int) -> np.ndarray:
        return _has(self.by_size, _sized(hashes, size, self.bits))


def _has(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = at.astype(np.int64)
    return (packed[at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1)).astype(bool)


def _sized(hashes: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Filter positions of shingles of items of `size` words."""
    return _mixed(hashes ^ np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(bits - 1)


def items_of(benchmark: DataFrame) -> DataFrame:
    """Rows (item_id, size, fp, hashes) of distinct items with words; equal ones go by the smallest id."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            out = []
            for item, text in zip(pdf["item_id"], pdf["text"]):
                w = word_hashes(text, words)
                if len(w):
                    h = shingles(w)
                    out.append((item, len(w), np.uint64(simhash(h)).view(np.int64), h.view(np.int64)))
            yield pd.DataFrame(out, columns=["item_id", "size", "fp", "hashes"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInPandas(each, "item_id long, size int, fp long, hashes array<long>")
    return rows.groupBy("size", "fp", "hashes").agg(F.min("item_id").alias("item_id"))


def item_filter(items: DataFrame) -> Filters:
    """The filters of all items, of a size that follows from how many shingles they have."""
    shingled, bits = items.agg(F.sum(F.size("hashes"))).first()[0] or 0, FILTER_BITS
    while bits < min(16 * shingled, FILTER_MOST):
        bits *= 2

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, hashes in zip(pdf["size"], pdf["hashes"]):
                h = np.asarray(hashes, np.int64).view(np.uint64)
                for which, at in ((0, h & np.uint64(bits - 1)), (1, _sized(h, size, bits))):
                    at = at.astype(np.int64)
                    yield pd.DataFrame({"which": which, "word": at >> 5, "bits": np.left_shift(1, at & 31)})

    words = items.select("size", "hashes").mapInPandas(each, "which int, word long, bits long").groupBy("which", "word").agg(F.bit_or("bits").alias("bits"))
    sets = np.zeros((2, bits // 32), np.uint32)
    got = words.toPandas()  # at most 2 * FILTER_MOST / 32 rows
    sets[got["which"].to_numpy(np.int64), got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    packed = sets.astype("<u4").view(np.uint8)
    return Filters(bits, packed[0], packed[1], sorted(r[0] for r in items.select("size").distinct().collect()))


def windows(docs: DataFrame, filters: Filters) -> DataFrame:
    """Rows (doc_id, start, size, content, fp, hashes): windows of an item's size that may reach the similarity.

    Two sets of a and b shingles reach it only if they share (a + b) * s / (1 + s). The filters
    have every shingle of the items, so windows with fewer hits than that share too few with any
    item and need no fingerprint; the others get one. A text shorter than an item is one window.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    share = SIMILARITY / (1 + SIMILARITY)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = shared.value
        words = Words()
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                w = word_hashes(text, words)
                if not len(w):
                    continue
                long = shingles(w)
                hits = np.flatnonzero(filters.knows(long))
                for size in filters.sizes:
                    h = long if size >= SHINGLE else shingles(w, size)
                    n = max(1, size - SHINGLE + 1)
                    here = min(n, len(h))
                    need = int(np.ceil((n + here) * share - 1e-9))
                    if size >= SHINGLE and len(hits) < need or here < need:
                        continue
                    near = hits if size >= SHINGLE else np.arange(len(h))
                    near = near[filters.knows_sized(h[near], size)]
                    if len(near) < need:
                        continue
                    # starts from which `need` hits lie within the window
                    first, last = near[: len(near) - need + 1], near[need - 1 :]
                    ok = last - first < here
                    starts = {s for a, b in zip(first[ok].tolist(), last[ok].tolist()) for s in range(max(0, b - here + 1), min(a, len(h) - here) + 1)}
                    for s in sorted(starts):
                        part = h[s : s + here]
                        out.append((doc, s, size, xxhash.xxh64_intdigest(part.tobytes(), size) - (1 << 63), np.uint64(simhash(part)).view(np.int64), part.view(np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "start", "size", "content", "fp", "hashes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        lean(each), "doc_id long, start int, size int, content long, fp long, hashes array<long>"
    )


def _block(fp: str, b: int):
    return F.shiftrightunsigned(F.col(fp), CUTS[b]).bitwiseAND(F.lit((1 << CUTS[b + 1] - CUTS[b]) - 1)).cast("int")


def hamming_pairs(found: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (content, item_id): windows and items of one size whose fingerprints differ in at most RADIUS bits.

    Fingerprints within the radius differ in at most RADIUS // BLOCKS bits in one of the blocks.
    Items enter the index under every value that near to each of their blocks, windows look up
    their own, so the equi-join misses none.
    """
    widths = [b - a for a, b in zip(CUTS, CUTS[1:])]
    masks = {w: [sum(1 << b for b in bits) for r in range(RADIUS // BLOCKS + 1) for bits in combinations(range(w), r)] for w in set(widths)}

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = {w: np.array(m, np.int64) for w, m in masks.items()}
        for pdf in batches:
            for item, size, fp in zip(pdf["item_id"], pdf["size"], pdf["fp"]):
                for b, w in enumerate(widths):
                    own = int(fp) >> CUTS[b] & ((1 << w) - 1)
                    yield pd.DataFrame({"size": size, "b": b, "v": own ^ near[w], "item_id": item, "ifp": fp})

    index = items.select("item_id", "size", "fp").mapInPandas(spread, "size int, b int, v int, item_id long, ifp long")
    asks = found.select("content", "size", "fp").dropDuplicates(["content"])
    asks = asks.select("content", "size", "fp", F.posexplode(F.array(*[_block("fp", b) for b in range(BLOCKS)])).alias("b", "v"))
    # the index has thousands of rows an item, which its statistics don't tell: never broadcast it
    met = asks.join(index.hint("merge"), ["size", "b", "v"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS)
    return met.select("content", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, similarity, start_word, n_words): where a text holds a benchmark item.

    One row for a text and an item: its most similar window, the first among equals. Words are
    runs of letters and digits in lower case; similarity is that of five-word shingles weighted
    by their repeats, 0.8 or more. Equal items are one, under their smallest id. Null or empty
    texts and items match nothing; rows that repeat a doc_id count as one text's; an empty
    table on either side gives an empty result.
    """
    items = cut(items_of(benchmark))
    found = cut(windows(docs, item_filter(items)))
    pairs = hamming_pairs(found, items)
    texts = found.select("content", "hashes").dropDuplicates(["content"])
    both = pairs.join(texts, "content").join(items.select("item_id", F.col("hashes").alias("item")), "item_id")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sim = [weighted_similarity(np.asarray(a, np.int64), np.asarray(b, np.int64)) for a, b in zip(pdf["hashes"], pdf["item"])]
            yield pdf[["content", "item_id"]].assign(similarity=sim)

    sure = both.select("content", "item_id", "hashes", "item").mapInPandas(each, "content long, item_id long, similarity double")
    sure = sure.where(F.col("similarity") >= SIMILARITY)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size"))
    rows = found.select("doc_id", "start", "size", "content").join(sure, "content").groupBy("doc_id", "item_id").agg(best.alias("x"))
    return rows.select("doc_id", "item_id", "x.similarity", (-F.col("x.back")).cast("long").alias("start_word"), F.col("x.size").cast("long").alias("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` whose own text holds no benchmark item, whatever doc_id they share or lack.

    A row is known by a 64-bit hash of its doc_id and text; rows equal in both go or stay together.
    Other columns stay as they are, under any name. An item of one word, or any that a text
    holds whole, counts however common it is. Null and empty texts stay; so
    does every row where the benchmark is empty.
    """
    key = F.xxhash64("doc_id", "text")
    hit = contamination(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("key")).distinct()
    return docs.select(key.alias("key"), F.struct("*").alias("row")).join(hit, "key", "left_anti").select("row.*")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
