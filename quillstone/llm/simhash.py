"""SimHash near-duplicates: vertical bit planes, carry-save counters, early abandonment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import WORD, components, cut, lean

BITS = 64
_UPPER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text: str | None, n: int = 4, seed: int = 42, step: int = 16384) -> int:
    """SimHash of a text's n-word shingles (repeats count), with XXH64 of their UTF-8 bytes.

    A bit is set if more than half the hashes set it; a text of fewer words is one shingle; a
    text without words, or null, has fingerprint 0. Counts are summed `step` shingles at a time.
    """
    words = re.findall(WORD, (text or "").translate(_UPPER))
    if not words:
        return 0
    line = " ".join(words).encode("utf-8", "surrogatepass")
    if len(words) <= n:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(ends + 1).tolist()], [*ends.tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[n - 1 :])], dtype="<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, fp long): the fingerprint's 64 bits as a signed long; the long columns `also` go along."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t) for t in pdf[text]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({key: pdf[key].astype("Int64"), **{c: pdf[c] for c in also}, "fp": fps})

    longs = "".join(f"{c} long, " for c in (key, *also))
    return docs.select(F.col(key).cast("long").alias(key), *also, text).mapInPandas(lean(each), f"{longs}fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """The vertical form of uint64 fingerprints: plane p holds bit p of 64 rows in each word."""
    width = -(-len(fps) // 64) * 64
    bits = np.zeros((width, BITS), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within_radius(fps: np.ndarray, planes: np.ndarray, row: np.ndarray, word: np.ndarray, mask: np.ndarray, radius: int, step: int = 65536) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) within `radius` bits, for rows i and the 64-row blocks `word` of `planes`.

    `mask` has a bit for each row of the block that counts. Differences of a plane are added to
    64 distances at once by carry-save counters; after every 8 planes, blocks all of whose
    distances exceed the radius are abandoned.
    """
    levels = radius.bit_length()
    found = []
    for at in range(0, len(row), step):
        i, w, ok = row[at : at + step], word[at : at + step], mask[at : at + step].copy()
        counts = [np.zeros(len(i), np.uint64) for _ in range(levels)]
        for p in range(BITS):
            carry = planes[p][w] ^ (np.uint64(0) - ((fps[i] >> np.uint64(p)) & np.uint64(1)))
            for k in range(levels):
                counts[k], carry = counts[k] ^ carry, counts[k] & carry
            ok &= ~carry
            if p % 8 == 7:
                # a distance over the radius: some counter bit above the radius' own bits
                over, same = np.zeros_like(ok), ~np.zeros_like(ok)
                for k in reversed(range(levels)):
                    if radius >> k & 1:
                        same = same & counts[k]
                    else:
                        over = over | (same & counts[k])
                        same = same & ~counts[k]
                ok &= ~over
                live = ok != 0
                if not live.all():
                    i, w, ok, counts = i[live], w[live], ok[live], [c[live] for c in counts]
                if not len(i):
                    break
        if len(i):
            hit, bit = np.nonzero(np.unpackbits(ok.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            found.append((i[hit], w[hit] * 64 + bit))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n rows over the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _link(fps: np.ndarray, bucket: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each run of equal `bucket`: (fp, smaller-index fp).

    side 2 marks a run of one block: all its rows meet. Otherwise rows of side 0 meet side 1.
    """
    n = len(fps)
    planes = planes_of(fps)
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    end = np.r_[start[1:], n][np.cumsum(np.r_[True, bucket[1:] != bucket[:-1]]) - 1]
    i = np.flatnonzero((end - np.arange(n) > 1) & (side != 1))
    first, last = (i + 1) // 64, (end[i] - 1) // 64
    a_all, b_all = [], []
    for at in range(0, len(i), 4096):
        rows, f, l = i[at : at + 4096], first[at : at + 4096], last[at : at + 4096]
        many = l - f + 1
        row = np.repeat(rows, many)
        word = np.repeat(f, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        low = np.clip(row + 1 - word * 64, 0, 64).astype(np.uint64)
        high = np.clip(end[row] - word * 64, 0, 64).astype(np.uint64)
        ones = ~np.zeros(len(row), np.uint64)
        upto = np.where(high == 64, ones, (np.uint64(1) << (high & np.uint64(63))) - np.uint64(1))
        mask = upto & ~((np.uint64(1) << (low & np.uint64(63))) - np.uint64(1))
        mask[low == 64] = 0
        a, b = within_radius(fps, planes, row, word, mask, radius)
        keep = (side[a] == 2) | (side[a] != side[b])
        a_all.append(a[keep])
        b_all.append(b[keep])
        if sum(map(len, a_all)) > 2_000_000:
            root = forest(n, np.concatenate(a_all), np.concatenate(b_all))
            a_all, b_all = [np.flatnonzero(root != np.arange(n))], [root[root != np.arange(n)]]
    if not a_all:
        none = np.zeros(0, np.uint64)
        return none, none
    root = forest(n, np.concatenate(a_all), np.concatenate(b_all))
    moved = np.flatnonzero(root != np.arange(n))
    return fps[moved], fps[root[moved]]


def fingerprint_links(fps: DataFrame, radius: int = 4, pieces: int = 6, block: int = 8192) -> DataFrame:
    """Edges (a long, b long) whose closure links all of distinct `fps(fp)` within `radius` bits.

    Two fingerprints that differ in at most `radius` bits agree on at least pieces - radius of
    `pieces` pieces of their bits, so one bucket for each choice of that many pieces holds them
    both. A bucket of more than `block` rows is cut into blocks and every two blocks meet in a
    task of their own. Tasks return a spanning forest of their links, at most one edge a row.
    """
    cuts = [BITS * k // pieces for k in range(pieces + 1)]
    masks = []
    for chosen in combinations(range(pieces), pieces - radius):
        masks.append(sum(((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in chosen))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("v")) for t, m in enumerate(signed)])
    rows = fps.select("fp", F.inline(tables))
    crowded = rows.groupBy("t", "v").agg(F.count("*").alias("n")).where(F.col("n") > block)
    crowded = cut(crowded.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"))
    if crowded.isEmpty():
        dealt = rows.withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(2)})
    else:
        rows = rows.join(crowded, ["t", "v"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = rows.withColumn("own", own).withColumn("o", other).select(
            "fp", "t", "v", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"),
            F.when(F.col("own") == F.col("o"), 2).when(F.col("own") < F.col("o"), 0).otherwise(1).alias("side"),
        )
    key = ["t", "v", "i", "j"]
    # the key is 64 bits of a hash; rows of two keys that share it meet as well, which is harmless
    dealt = dealt.select("fp", F.xxhash64(*key).alias("bucket"), F.col("side").cast("int").alias("side"))
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "side")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def flush(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = _link(pdf["fp"].to_numpy().view(np.uint64), pdf["bucket"].to_numpy(), pdf["side"].to_numpy(), radius)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()

        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size < 200_000:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = whole["bucket"].to_numpy() == whole["bucket"].iloc[-1]
            if not last.all():
                yield flush(whole[~last])
            held, size = [whole[last].reset_index(drop=True)], int(last.sum())
        if size:
            yield flush(pd.concat(held, ignore_index=True))

    return dealt.mapInPandas(lean(each), "a long, b long")


def rooted(nodes: DataFrame, radius: int) -> DataFrame:
    """`nodes` of distinct fp with `root`, one fingerprint of each component of links within `radius`."""
    roots = components(fingerprint_links(nodes.select("fp"), radius))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_groups(docs: DataFrame, radius: int = 4) -> DataFrame:
    """Rows (doc_id, fp long, component_id): one for each row of `docs`.

    component_id is the smallest doc_id whose fingerprint is reachable over links of at most
    `radius` differing bits (null doc_ids count only where a component has no other). Equal
    fingerprints are compared once. Texts without words all have fingerprint 0 and link with
    each other and with any other near 0; an empty table gives an empty one.
    """
    prints = cut(fingerprints(docs))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    known = rooted(nodes, radius)
    lows = known.groupBy("root").agg(F.min("low").alias("component_id"))
    named = cut(known.join(lows, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 4) -> DataFrame:
    """The rows of `docs` that stand for their group: one of each group.

    It is the row with the smallest doc_id, rows without one last, and among equals the smallest
    hash of the text. A row is known by its doc_id and that hash, so equal doc_ids, or none, in
    several groups don't meet; of rows equal in both one stays. Other columns pass through under any name.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), F.struct("*").alias("row"))
    prints = fingerprints(rows.select("doc_id", "hash", F.col("row.text").alias("text")), also=("hash",))
    copies = prints.groupBy("fp", "doc_id", "hash").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "n"))
    nodes = cut(copies.groupBy("fp").agg(first.alias("first")))
    firsts = cut(rooted(nodes, radius).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("kept"), F.col("first.hash").alias("kept_hash"), F.col("first.n").alias("n")))
    once, more = firsts.where("n = 1"), firsts.where("n > 1")
    on = F.col("doc_id").eqNullSafe(F.col("kept")) & (F.col("hash") == F.col("kept_hash"))
    kept = rows.join(once, on, "left_semi").select("row")
    if not more.isEmpty():
        one = rows.join(more, on, "left_semi").groupBy("doc_id", "hash").agg(F.first("row").alias("row"))
        kept = kept.unionByName(one.select("row"))
    return kept.select("row.*")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
