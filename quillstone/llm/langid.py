"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from quillstone.llm.common import cut

#: Letters are the characters of Unicode's category L: no digits, number signs, circled or superscript forms.
LETTER = regex.compile(r"\p{L}")
OTHERS = regex.compile(r"[^\p{L}\p{M}]+")


@dataclass
class Automaton:
    """Transitions in one table: state s goes on symbol c by slot base[s] + c, if that slot is owned by s."""

    base: np.ndarray  # int32[states]
    slots: np.ndarray  # int64: owner << 32 | next state; -1 where free


@dataclass
class Models:
    """Symbols of all characters of the samples by UTF-16 unit, and one automaton for each language."""

    langs: list[str]
    symbols: np.ndarray  # int32[65536]; 0 for characters that no sample holds
    steps: list[Automaton]
    scale: list[float]  # bits that a phrase costs


def transitions(text: np.ndarray) -> list[dict[int, int]]:
    """Edges of the smallest automaton of all substrings of `text`; state 0 is none, 1 the start."""
    go: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in text.tolist():
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
        last = new
    return go


def suffix_automaton(text: np.ndarray, width: int) -> np.ndarray:
    """The transitions as a dense table of `width` symbols."""
    go = transitions(text)
    table = np.zeros((len(go), width), np.int32)
    for s, edges in enumerate(go):
        for c, t in edges.items():
            table[s, c] = t
    return table.reshape(-1)


def packed(text: np.ndarray, width: int, tries: int = 48) -> Automaton:
    """The transitions with the rows of all states laid over each other, for any number of symbols.

    Rows go by size, each to the first of some drawn places where its slots are free, else behind
    the others. A table has a few slots a character of text, however wide the alphabet.
    """
    go = transitions(text)
    draw = random.Random(1)
    slots = [-1] * (2 * sum(map(len, go)) + 1)
    base = np.zeros(len(go), np.int64)
    for s in sorted(range(len(go)), key=lambda s: -len(go[s])):
        edges = go[s]
        if not edges:
            continue
        low = min(edges)
        span = max(edges) - low
        for _ in range(tries):
            at = int(draw.random() * (len(slots) - span)) if span < len(slots) else len(slots)
            if at == len(slots) or all(slots[at + c - low] < 0 for c in edges):
                break
        else:
            at = len(slots)
        if at + span >= len(slots):
            slots.extend([-1] * (at + span + 1 - len(slots)))
        for c, t in edges.items():
            slots[at + c - low] = s << 32 | t
        base[s] = at - low
    room = np.full(width, -1, np.int64)  # any base plus any symbol is a slot
    return Automaton((base + width).astype(np.int32), np.concatenate([room, np.array(slots, np.int64), room]))


def clean(text: str) -> str:
    """Lower case, every run of characters that are neither letters nor their marks one space."""
    return OTHERS.sub(" ", text.lower())


def _run(text: str, length: int) -> str:
    """`length` characters of `text` from a place that its hash chooses; all of a shorter text."""
    at = zlib.crc32(text.encode("utf-8", "surrogatepass")) % max(1, len(text) - length + 1)
    return text[at : at + length]


def train(texts: dict[str, list[str]], chars: int = 24_000) -> Models:
    """Models of about `chars` characters of each language's cleaned sample text.

    Each text gives a run of it, from anywhere in the text; what short texts leave goes to longer
    ones. Every character of the runs is a symbol of its own. A language without letters has no
    model. A phrase costs a pointer into the language's text and a symbol, so that little text,
    which is pointed into cheaply, doesn't make up for phrases of single characters.
    """
    joined = {}
    for lang, parts in sorted(texts.items()):
        runs, left = [], chars
        cleaned = sorted((clean(p) for p in parts), key=len)
        for k, p in enumerate(cleaned):
            runs.append(_run(p, max(64, left // (len(cleaned) - k))))
            left -= len(runs[-1])
        if LETTER.search(text := " ".join(runs)):
            joined[lang] = text
    units = {k: np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16) for k, t in joined.items()}
    symbols = np.zeros(65536, np.int32)
    known = np.unique(np.concatenate([np.zeros(0, np.uint16), *units.values()]))
    symbols[known] = np.arange(1, len(known) + 1)
    steps = [packed(symbols[u], len(known) + 1) for u in units.values()]
    literal = np.log2(len(known) + 1)
    return Models(list(joined), symbols, steps, [float(np.log2(max(2, len(u))) + literal) for u in units.values()])


def _units(text: str, symbols: np.ndarray) -> np.ndarray:
    return symbols[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)]


def _follow(step: Automaton, state: np.ndarray, sym: np.ndarray) -> np.ndarray:
    """The states that follow, 0 where the text has no such continuation."""
    slot = step.slots[step.base[state] + sym]
    return np.where(slot >> 32 == state, slot & 0xFFFFFFFF, 0).astype(np.int32)


def phrases(texts: list[str], models: Models, segment: int = 1024) -> np.ndarray:
    """Phrases [text, language] of the greedy parse of each whole text into longest matches.

    A phrase ends where the automaton has no continuation; that character begins the next. Texts
    are cut into segments, and all segments step together, each as if a phrase began with it.
    Then every segment is parsed once more from the state in which the one before ends, until it meets its own
    earlier course, mostly after a phrase or two; one that never does passes its new end on.
    """
    coded = [_units(t, models.symbols) for t in texts]
    counts = np.array([-(-len(c) // segment) for c in coded], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    grid = np.zeros((len(owner), segment), np.int32)
    filled = np.full(len(owner), segment, np.int64)
    at = 0
    for c, n in zip(coded, counts):
        grid[at : at + n].reshape(-1)[: len(c)] = c
        if n:
            filled[at + n - 1] = len(c) - (n - 1) * segment
        at += n
    order = np.argsort(-filled, kind="stable")
    columns = np.ascontiguousarray(grid[order].T)
    size = filled[order]
    live = np.searchsorted(-size, -np.arange(segment), side="left")
    lane = np.empty(len(order), np.int64)
    lane[order] = np.arange(len(order))
    later = np.r_[owner[1:] == owner[:-1], np.zeros(min(1, len(owner)), bool)]  # segments that another follows
    follower = np.full(len(order), -1)
    follower[lane[np.flatnonzero(later)]] = lane[np.flatnonzero(later) + 1]
    leader = np.full(len(order), -1)
    leader[follower[follower >= 0]] = np.flatnonzero(follower >= 0)
    out = np.zeros((len(texts), len(models.langs)))
    course = np.empty((segment, len(order)), np.int32)
    begun = np.zeros((segment, len(order)), bool)
    every = np.arange(int(models.symbols.max()) + 1)
    for k, step in enumerate(models.steps):
        start = _follow(step, np.ones(len(every), np.int32), every)

        def move(state: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The next states, and where a phrase begins."""
            nxt = _follow(step, state, sym)
            ended = nxt == 0
            again = np.flatnonzero(ended)
            fresh = start[sym[again]]
            nxt[again] = np.where(fresh == 0, 1, fresh)
            return nxt, ended | (state == 1)

        state = np.ones(len(order), np.int32)
        for pos in range(segment):
            m = live[pos]
            if not m:
                break
            state[:m], begun[pos, :m] = move(state[:m], columns[pos, :m])
            course[pos, :m] = state[:m]
        todo = np.flatnonzero(leader >= 0)
        while len(todo):
            state, lanes, changed = course[size[leader[todo]] - 1, leader[todo]], todo, []
            for pos in range(segment):
                inside = pos < size[lanes]
                changed.append(lanes[~inside])
                lanes, state = lanes[inside], state[inside]
                if not len(lanes):
                    break
                state, begun[pos, lanes] = move(state, columns[pos, lanes])
                apart = state != course[pos, lanes]
                lanes, state = lanes[apart], state[apart]
                course[pos, lanes] = state
            changed.append(lanes)
            todo = follower[np.concatenate(changed)]
            todo = np.unique(todo[todo >= 0])
        np.add.at(out[:, k], owner[order], (begun & (np.arange(segment)[:, None] < size)).sum(axis=0))
    return out


def sample_texts(docs: DataFrame, rows: int = 300, chars: int = 24_000) -> dict[str, list[str]]:
    """About `rows` distinct texts of each language, or all of fewer, by a hash of the text.

    The share of each language that is read follows from its count, so no group is collected. Of
    a text comes a run of twice its part of `chars` from anywhere in it: what a language brings
    to the driver is bounded, the number of languages is not.
    """
    docs = docs.where("lang is not null and text is not null").withColumn("_h", F.xxhash64("text", F.lit(7)))
    counts = cut(docs.groupBy("lang").agg(F.approx_count_distinct("_h").alias("count")))
    if counts.limit(10_001).count() <= 10_000:  # else the join shuffles
        counts = F.broadcast(counts)
    draw = F.pmod(F.col("_h"), F.lit(1_000_003)) / 1_000_003.0
    taken = docs.join(counts, "lang").where(draw <= rows / F.col("count"))
    size = F.ceil(2 * chars / F.least(F.lit(rows), F.greatest(F.lit(1), F.col("count")))).cast("int")
    at = F.pmod(F.xxhash64("text", F.lit(11)), F.greatest(F.lit(1), F.length("text") - size + 1)).cast("int") + 1
    runs = taken.select("lang", "_h", F.substring("text", at, size).alias("run")).groupBy("lang", "_h").agg(F.min("run").alias("run"))
    out: dict[str, list[str]] = {}
    for lang, _, text in sorted(map(tuple, runs.collect())):
        out.setdefault(lang, []).append(text)
    return out


def predict_language(docs: DataFrame, models: Models) -> DataFrame:
    """`docs` with lang_pred and score (0 to 1: how much fewer phrases the best needs than the next).

    The language whose phrases, each at the cost of a pointer into its text, are fewest wins,
    ties by name. `und`, with score 0, where the text is null or has no letter or nothing was learned. Input
    columns of these names are replaced; an empty table gives an empty one.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType())

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            texts = [clean(t) if isinstance(t, str) and LETTER.search(t) else "" for t in pdf["text"]]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if m.langs:
                size = np.cumsum([len(t) for t in texts])
                cuts = np.searchsorted(size, np.arange(4_000_000, (size[-1] if len(size) else 0) + 1, 4_000_000))
                for rows in np.split(np.arange(len(texts)), np.unique(cuts)):
                    cost = phrases([texts[r] for r in rows], m) * np.array(m.scale)
                    for r, c in zip(rows, cost):
                        if texts[r].strip():
                            best = int(np.argmin(c))
                            rest = np.delete(c, best)
                            pred[r], score[r] = m.langs[best], float(np.clip(1 - c[best] / rest.min(), 0, 1)) if len(rest) else 1.0
            yield pdf.assign(lang_pred=np.array(pred, object), score=score)

    return docs.mapInPandas(each, schema)


def op7_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    models = train(sample_texts(docs.where(F.coalesce(~held, F.lit(False)))))
    out = predict_language(docs.select("doc_id", "text"), models)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
