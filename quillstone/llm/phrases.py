"""Collocations by growing contiguous patterns: occurrences projected by prefix, extended to the right depth first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import cut, lean

# What ends a piece, and what separates words; byte 255 stands in no UTF-8 text.
ENDS = b".,;:!?\n\x0b\x0c\r"
END = b"\xff"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ENDS, b"abcdefghijklmnopqrstuvwxyz" + END * len(ENDS))
WORDS_HELD, SEEN_HELD = 1 << 20, 1 << 21


def words_of(text: bytes) -> list[bytes]:
    """The folded words of a text, with END where a piece ends."""
    return text.translate(_FOLD).replace(END, b" \xff ").split()


def symbol(lang: bytes, word: bytes, seed: int, bits: int = 63) -> int:
    """A word's symbol: `bits` bits of a hash of language and word, never 0."""
    return (xxhash.xxh3_64_intdigest(lang + b"\x00" + word, seed) >> (64 - bits)) or 1


class _Numbers(dict):
    """Words by order of appearance; END is 0."""

    def __init__(self) -> None:
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, np.ndarray, _Numbers]]:
    """Numbered words of a task's texts, one language at a time, in runs of bounded length.

    A run ends between texts once it holds SEEN_HELD words or WORDS_HELD distinct ones.
    """
    held: dict[bytes, tuple[_Numbers, list[np.ndarray]]] = {}
    sizes: dict[bytes, int] = {}

    def flush(lang: bytes) -> tuple[bytes, np.ndarray, _Numbers]:
        numbers, runs = held.pop(lang)
        del sizes[lang]
        return lang, np.concatenate(runs), numbers

    for batch in batches:
        langs = batch.column("lang").cast(pa.binary()).to_pylist()
        for lang, text in zip(langs, batch.column("text").cast(pa.binary())):
            words = words_of(text.as_py())
            if not words:
                continue
            if lang not in held:
                held[lang], sizes[lang] = (_Numbers(), []), 0
            numbers, runs = held[lang]
            ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            runs.append(np.append(ids, 0))
            sizes[lang] += len(words)
            if sizes[lang] >= SEEN_HELD or len(numbers) >= WORDS_HELD:
                yield flush(lang)
        while sum(map(len, (n for n, _ in held.values()))) > 4 * WORDS_HELD or sum(sizes.values()) > 4 * SEEN_HELD:
            yield flush(max(sizes, key=sizes.__getitem__))
    for lang in list(held):
        yield flush(lang)


def texts_by_lang(docs: DataFrame) -> DataFrame:
    """Rows (lang, text) without nulls: a null lang is `und`, a null text is empty."""
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_counts(texts: DataFrame, seed: int, bits: int = 63) -> DataFrame:
    """Rows (s, lang, word, other, f) for each word's symbol, with 0 for a language's total in rows without word.

    `other` differs from `word` where two words of the corpus share a symbol. Words are counted
    in the task before the shuffle.
    """
    shape = pa.schema([("s", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, numbers in _by_lang(batches):
            counts = np.bincount(ids, minlength=len(numbers))[1:]
            words = list(numbers)[1:]
            name = lang.decode()
            total = [[-symbol(lang, b"", seed)], [name], [""], [int(counts.sum())]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(total, shape.types)], schema=shape)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([symbol(lang, w, seed, bits) for w in part], pa.int64()), pa.array([name] * len(part)), pa.array([w.decode() for w in part]), pa.array(counts[at : at + 50_000])], schema=shape
                )

    rows = texts.mapInArrow(lean(each), "s long, lang string, word string, f long")
    both = F.struct("lang", "word")
    counted = rows.groupBy("s").agg(F.min(both).alias("w"), F.max(both).alias("other"), F.sum("f").alias("f"))
    return counted.select("s", "w.lang", "w.word", "other", (F.col("w") != F.col("other")).alias("shared"), "f")


def projected(texts: DataFrame, longest: int, split: dict[int, int], seed: int, bits: int = 63) -> DataFrame:
    """Rows (s1, part, s2, ..., n): occurrences of each word, with the words that follow it in its piece, 0 where none does.

    What is projected of an occurrence is all that growth to `longest` words can read. Equal
    projections of a task are counted there. A word of `split` has that many parts, by what follows.
    """
    names = [f"s{k + 1}" for k in range(longest)]
    shape = pa.schema([(c, pa.int64()) for c in (*names, "part", "n")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, numbers in _by_lang(batches):
            known = np.array([0, *[symbol(lang, w, seed, bits) for w in list(numbers)[1:]]], np.int64)
            parts = np.array([split.get(int(s), 1) for s in known], np.int64)
            ids = np.append(ids, np.zeros(longest, np.int64))
            cols = [ids[k : len(ids) - longest + k] for k in range(longest)]
            cols = [c[(cols[0] > 0) & (cols[1] > 0)] for c in cols]
            for k in range(2, longest):
                cols[k] = np.where(cols[k - 1] > 0, cols[k], 0)
            order = np.lexsort(cols[::-1])
            cols = [c[order] for c in cols]
            if not len(order):
                continue
            new = np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)]
            at = np.flatnonzero(new)
            n = np.diff(np.r_[at, len(order)])
            syms = [known[c[at]] for c in cols]
            mix = np.zeros(len(at), np.uint64)
            for s in syms[1:]:
                mix = (mix ^ s.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            part = ((mix >> np.uint64(33)) % parts[cols[0][at]].astype(np.uint64)).astype(np.int64)
            for a in range(0, len(at), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000]) for c in (*syms, part, n)], schema=shape)

    return texts.mapInArrow(lean(each), ", ".join(f"{c} long" for c in (*names, "part", "n")))


def grow(rows: list[np.ndarray], n: np.ndarray, least: int, whole: bool, at: int = 0, depth: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Frequent extensions of a prefix, depth first: (words, indices of rows that begin with them, their counts).

    `rows` are the sorted projections' symbols by depth, all alike before `depth`, from index `at` on.
    If not `whole`, the prefix has other parts, which may share all extensions but those of full length: such
    are given whatever their count.
    """
    follow, longest = rows[depth], len(rows)
    begin = np.flatnonzero(np.r_[True, follow[1:] != follow[:-1]])
    counts = np.add.reduceat(n, begin)
    often = counts >= least
    given = (follow[begin] != 0) & (often | (not whole and depth + 1 < longest))
    if given.any():
        yield depth + 1, at + begin[given], counts[given]
    if depth + 1 == longest:
        return
    end = np.r_[begin[1:], len(n)]
    deeper = (follow[begin] != 0) & (often | (not whole and depth + 2 < longest))
    for a, b in zip(begin[deeper].tolist(), end[deeper].tolist()):
        yield from grow([r[a:b] for r in rows], n[a:b], least, whole, at + a, depth + 1)


def frequent_phrases(texts: DataFrame, longest: int, least: int, split: dict[int, int], seed: int, bits: int = 63) -> DataFrame:
    """Rows (phrase array<long>, f): phrases of 2 to `longest` symbols that occur `least` times or more.

    Each prefix (a part of a split one) is one task's group: its projections come sorted and are
    grown depth first. Parts of a split prefix give what they have, and their counts are summed.
    """
    names = [f"s{k + 1}" for k in range(longest)]
    hot = np.array(sorted(split), np.int64)
    shape = pa.schema([("phrase", pa.list_(pa.int64())), ("f", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(cols: list[np.ndarray], n: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Phrases of whole prefixes; a prefix that is itself too rare is passed over."""
            key = np.flatnonzero(np.r_[True, (cols[0][1:] != cols[0][:-1]) | (part[1:] != part[:-1])])
            whole = ~np.isin(cols[0][key], hot)
            todo = (np.add.reduceat(n, key) >= least) | ~whole
            found: dict[int, list[tuple]] = {}
            for a, b, w in zip(key[todo].tolist(), np.r_[key[1:], len(n)][todo].tolist(), whole[todo].tolist()):
                for words, at, counts in grow([x[a:b] for x in cols], n[a:b], least, w, a):
                    found.setdefault(words, []).append((at, counts))
            for words, got in found.items():
                at, counts = (np.concatenate(x) for x in zip(*got))
                flat = np.stack([c[at] for c in cols[:words]], axis=1).reshape(-1)
                ends = pa.array(np.arange(0, len(flat) + 1, words), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array(counts)], schema=shape)

        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in (*names, "part", "n")]
            held.append(cols)
            size += len(cols[0])
            if size < 200_000:
                continue
            whole = [np.concatenate(c) for c in zip(*held)]
            same = (whole[0] == whole[0][-1]) & (whole[longest] == whole[longest][-1])
            stop = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if stop:
                yield from settle([c[:stop] for c in whole[:longest]], whole[-1][:stop], whole[longest][:stop])
            held, size = [[c[stop:] for c in whole]], len(same) - stop
        if size:
            whole = [np.concatenate(c) for c in zip(*held)]
            yield from settle(whole[:longest], whole[-1], whole[longest])

    rows = projected(texts, longest, split, seed, bits)
    dealt = rows.repartition("s1", "part").sortWithinPartitions("s1", "part", *names[1:])
    found = dealt.mapInArrow(lean(each), "phrase array<long>, f long")
    return found.groupBy("phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, hot: int = 1000, bits: int = 63) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of `docs(lang, text)`.

    Words are runs without blank or tab in the pieces between `.,;:!?` and line ends, A-Z in lower case. A phrase
    of 2 to `longest` words that occurs a >= `least` times is cut in two (l and r occurrences)
    where floor(1000000 a a / (l r)) is least, the earliest of equal ones. It goes if a
    longer such phrase holds it and occurs at least `inside` percent as often. Counts are of all texts, per
    language, and products exact for counts below 10^15. A null lang is `und`; a
    null or empty text has no words; repeated rows count as often as they stand; an empty table
    gives an empty one; other columns are not read.

    Words with more than one in `hot` of all occurrences, at most `hot` of them, are split over tasks.
    Words go by hashes of `bits` bits; a seed is sought under which no two words of the corpus share one.
    """
    texts = texts_by_lang(docs)
    seed = 0
    while True:
        counted = cut(word_counts(texts, seed, bits).where((F.col("f") >= least) | (F.col("s") < 0) | F.col("shared")))
        if counted.where("shared").isEmpty():
            break
        seed += 1
    totals = counted.where("s < 0").select("lang", F.col("f").alias("n"))
    words = counted.where("s > 0")
    every = totals.agg(F.sum("n")).first()[0] or 0
    split = {r["s"]: -(-r["f"] * hot // every) for r in words.where(F.col("f") * hot > every).select("s", "f").collect()}
    found = cut(frequent_phrases(texts, longest, least, split, seed, bits))
    spelled = found.select("phrase", "f", F.posexplode("phrase").alias("at", "s")).join(words.select("s", "lang", "word"), "s")
    spelled = spelled.groupBy("phrase", "f").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("ws"))
    spelled = cut(spelled.select("phrase", F.col("f").alias("a"), "lang", F.array_join("ws.word", " ").alias("text")))
    counts = found.unionByName(words.select(F.array("s").alias("phrase"), "f"))
    k = F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k")
    cuts = spelled.select("phrase", "a", "lang", "text", k)
    size = F.size("phrase")
    cuts = cuts.withColumns({"left": F.slice("phrase", F.lit(1), F.col("k")), "right": F.slice("phrase", F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(counts.select(F.col("phrase").alias("left"), F.col("f").alias("l")), "left").join(counts.select(F.col("phrase").alias("right"), F.col("f").alias("r")), "right")
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.expr("(a * a * CAST(1000000 AS DECIMAL(7,0))) DIV (l * r)")
    cuts = cuts.withColumns({c: exact(c) for c in ("a", "l", "r")}).withColumn("score", score)
    best = cuts.groupBy("phrase", "a", "lang", "text").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # contiguous parts of every phrase, two words or more, with the most frequent phrase around them
    spans = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("phrase", i, m)))))
    around = spelled.where(size > 2).select(F.col("a").alias("longer"), spans.alias("phrase")).groupBy("phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(around, "phrase", "left").where(~F.coalesce(F.lit(100) * F.col("longer") >= F.lit(inside) * F.col("a"), F.lit(False)))
    best_first = [F.col("b.score").desc(), F.col("a").desc(), "text"]
    # a language's first are among the first of each of its 64 parts, so no task ranks all its phrases
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*best_first)
    kept = kept.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    order = Window.partitionBy("lang").orderBy(*best_first)
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return ranked.join(totals, "lang").select(
        "lang", long("rank", "rank"), F.col("text").alias("phrase"), long("a", "a"), long("b.l", "l"), long("b.r", "r"), long("n", "n"), long("b.score", "score")
    )


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), seqs AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
  FROM seqs, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m
), f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 10),
halves AS (
  SELECT *, array_to_string(w[1:k], ' ') AS first_part, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, (1000000 * c.a * c.a) // (x.a * y.a) AS score
  FROM halves c JOIN f x ON x.lang = c.lang AND x.phrase = c.first_part JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, part, max(a) AS longer FROM (
    SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM cand WHERE m = 3) GROUP BY ALL
), ranked AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest l LEFT JOIN around o ON o.lang = l.lang AND o.part = l.phrase WHERE coalesce(100 * longer < 50 * a, true)
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
