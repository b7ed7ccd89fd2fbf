"""Words of unspaced text by a dictionary that is locked by version and digest."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructType


class LockError(ValueError):
    """The dictionary is not the one that results are pinned to."""


@dataclass(frozen=True)
class Dictionary:
    """Log shares of words, and the length of the longest."""

    version: str
    weights: dict[str, float]
    longest: int
    rare: float


def load_dictionary(path: str, version: str, sha256: str, found_version: str) -> Dictionary:
    """Lines "word count ..." of a UTF-8 file; raises unless version and digest are those pinned."""
    if version != found_version:
        raise LockError(f"version {found_version}, not {version}")
    with open(path, "rb") as f:
        data = f.read()
    if (digest := hashlib.sha256(data).hexdigest()) != sha256:
        raise LockError(f"digest {digest}, not {sha256}")
    counts = {}
    for line in data.decode("utf-8").splitlines():
        word, *rest = line.split()
        counts[word] = counts.get(word, 0) + int(rest[0] if rest else 1)
    total = math.log(max(1, sum(counts.values())))
    weights = {w: math.log(n) - total for w, n in counts.items() if n > 0}
    return Dictionary(version, weights, max(map(len, weights), default=1), -total)


def segment(text: str, words: Dictionary) -> list[str]:
    """The likeliest words of a text, the longer first word among equals; unknown characters stand
    alone, but for runs of Latin letters and digits. White space only separates."""
    out = []
    for part in text.split():
        n = len(part)
        best, step = [0.0] * (n + 1), [1] * n
        for i in range(n - 1, -1, -1):
            choice = (words.weights.get(part[i], words.rare) + best[i + 1], 1)
            for k in range(2, min(words.longest, n - i) + 1):
                w = words.weights.get(part[i : i + k])
                if w is not None:
                    choice = max(choice, (w + best[i + k], k))
            best[i], step[i] = choice
        at, run = 0, ""
        while at < n:
            word = part[at : at + step[at]]
            at += len(word)
            if len(word) == 1 and word.isascii() and word.isalnum():
                run += word
                continue
            out += [run, word] if run else [word]
            run = ""
        out += [run] if run else []
    return out


def segmented(rows: DataFrame, text: str, name: str, words: Dictionary) -> DataFrame:
    """`rows` with the words of `text` as array `name`; null texts have null."""
    shared = rows.sparkSession.sparkContext.broadcast(words)
    rows = rows.drop(name)
    schema = StructType(list(rows.schema.fields)).add(name, ArrayType(StringType()))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{name: [segment(t, shared.value) if isinstance(t, str) else None for t in pdf[text]]})

    return rows.mapInPandas(each, schema)


def dictionary_of(words: DataFrame, word: str, version: str, most: int = 200_000) -> tuple[Dictionary, str]:
    """A dictionary of counted words with its digest, of the lines "word count" by word; more than `most` distinct words raise.

    It goes to every task, so its size is checked before anything comes to the driver. Null and blank words, and those with white space, don't count.
    """
    from pyspark.sql import functions as F

    counted = words.where(F.col(word).isNotNull() & ~F.col(word).rlike(r"(?U)\s|^$")).groupBy(word).agg(F.count("*").alias("n"))
    found = counted.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} words")
    counts = sorted((r[word], r["n"]) for r in found)
    digest = hashlib.sha256("".join(f"{w} {n}\n" for w, n in counts).encode("utf-8")).hexdigest()
    total = math.log(max(1, sum(n for _, n in counts)))
    weights = {w: math.log(n) - total for w, n in counts}
    return Dictionary(version, weights, max(map(len, weights), default=1), -total), digest
