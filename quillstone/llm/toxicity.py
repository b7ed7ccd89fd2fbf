"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from quillstone.llm.common import lean

# The grammar's word classes before anything is learned. Labels add words to each
# class, and take out those that labelled rows show to be harmless.
INSULTS = (
    "asshole bastard bitch clown coward cretin degenerate disgusting dumb fool freak garbage idiot imbecile "
    "jerk loser lowlife maggot moron parasite pathetic pig retard scum stupid trash vermin wimp worthless"
).split()
THREATS = "beat burn crush cut destroy die drown hang harm hit hunt hurt kill murder punch shoot smash stab strangle".split()
TARGETS = (
    "he her him his she that their them these they this those u ur you your yours yourself "
    "dein deine dich dir du ihr euch eure ihn tu toi te vous ton votre tú ti usted ustedes vosotros"
).split()
NEGATIONS = (
    "ain't barely cannot doesn't don't hardly isn't never nobody no none not nothing wasn't without won't "
    "nicht kein keine nie niemals pas jamais aucun aucune nunca jamás ningún ninguna"
).split()
REPORTS = (
    "accused alleged claimed quote quoted replied reported said saying says shouted told wrote "
    "sagte schrieb behauptete dit écrit affirmé dijo escribió afirmó"
).split()

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n\"“”«»]")
#: Symbols of the grammar.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = range(8)
ALPHABET = range(8)
SCORED = (INSULT, THREAT)
#: The longest piece of a word that the lexicon weighs, and its least weight.
LONGEST, LEAST = 8, 1.5
#: From this weight on a word alone nearly decides.
SURE = 2.5
#: Rows that must have a piece before its own counts may speak for it.
OFTEN = 12


@dataclass(frozen=True)
class Transducer:
    """Deterministic and weighted: `arcs[state, symbol]` is (next state, weight); absent arcs stay, at weight 1."""

    arcs: dict
    start: object = 0

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, 1.0))


def insults() -> Transducer:
    return Transducer({(0, INSULT): (0, 1.0)})


def threats() -> Transducer:
    """A threat word counts little unless another clause part makes it one."""
    return Transducer({(0, THREAT): (0, 0.25)})


def targets(gain: float = 1.5) -> Transducer:
    """From a target word to the clause's end, what is said is said of someone."""
    return Transducer({(0, TARGET): (1, 1.0), (1, END): (0, 1.0), (1, INSULT): (1, gain), (1, THREAT): (1, 2 * gain)})


def negations(reach: int = 3, keep: float = 0.3) -> Transducer:
    """A negation weakens what follows within `reach` words of its clause."""
    arcs = {(n, NEGATION): (reach, 1.0) for n in range(reach + 1)}
    for n in range(1, reach + 1):
        arcs |= {(n, s): (n - 1, keep if s in SCORED else 1.0) for s in (OTHER, INSULT, THREAT, TARGET, REPORT)}
        arcs[n, END] = (0, 1.0)
    return Transducer(arcs)


def reports(keep: float = 0.5) -> Transducer:
    """After a verb of speech, and inside quotation marks that follow one, speech is another's."""
    arcs = {(0, REPORT): (1, 1.0), (1, QUOTE): (2, 1.0), (2, QUOTE): (0, 1.0), (1, END): (0, 1.0)}
    return Transducer(arcs | {(n, s): (n, keep) for n in (1, 2) for s in SCORED})


@dataclass
class Grammar:
    """The product of transducers as tables: next state and weight by state * symbols + symbol."""

    move: list[int] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)


def compose(*parts: Transducer) -> Grammar:
    states = {tuple(p.start for p in parts): 0}
    todo, out = list(states), Grammar()
    for state in todo:  # grows while it runs
        for symbol in ALPHABET:
            steps = [p.step(s, symbol) for p, s in zip(parts, state)]
            to = tuple(s for s, _ in steps)
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            out.move.append(states[to])
            out.weight.append(math.prod(w for _, w in steps))
    return out


GRAMMAR = compose(insults(), threats(), targets(), negations(), reports())


def finder(known: dict) -> ahocorasick.Automaton | None:
    """An automaton that finds all known pieces in a marked word; none where nothing is known."""
    if not known:
        return None
    out = ahocorasick.Automaton()
    for piece, value in known.items():
        out.add_word(piece, value)
    out.make_automaton()
    return out


class Lexicon(dict):
    """word -> (symbol, weight), worked out once a word and forgotten beyond `most` words."""

    def __init__(self, learned: dict[str, float], most: int = 150_000):
        super().__init__()
        learned = learned if isinstance(learned, Learned) else Learned(learned)
        self.pieces, self.most = finder(learned), most
        self.fixed = {w: (INSULT, 2.0) for w in INSULTS} | {w: (THREAT, 2.0) for w in THREATS}
        for words, symbol in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
            self.fixed |= {w: (symbol, 0.0) for w in words}
        for word in learned.harmless:
            self.fixed.pop(word, None)
        self.fixed |= learned.classes
        for mark in ".!?;:\n":
            self.fixed[mark] = (END, 0.0)
        for mark in '"“”«»':
            self.fixed[mark] = (QUOTE, 0.0)

    def __missing__(self, word: str):
        got = self.fixed.get(word, (OTHER, 0.0))
        if got[0] in (OTHER, INSULT) and self.pieces:
            best = max((w for _, w in self.pieces.iter(f"^{word}$")), default=0.0)
            if best > 0:
                got = (INSULT, max(best, got[1]))
        if len(self) >= self.most:
            self.clear()
        self[word] = got
        return got


def _densest(at: list[int], gain: list[float], reach: int) -> float:
    """The largest sum of gains at places less than `reach` apart."""
    best = now = 0.0
    low = 0
    for k, place in enumerate(at):
        now += gain[k]
        while at[low] <= place - reach:
            now -= gain[low]
            low += 1
        best = max(best, now)
    return best


def clause_features(text: str | None, lexicon: Lexicon, reach: int = 100) -> list[float]:
    """Logs of what sure words score in the text's worst `reach` words and what all words score in it, the most
    that a word scores in its clause, and the log of what all score in the worst `reach` words, per 100 words.

    None of them falls as text is added beyond `reach` words. Sure words count as such only where
    the grammar doesn't weaken them: a negated or reported insult has what the other three make of it.
    """
    tokens = TOKEN.findall((text or "").lower())
    marks = [lexicon[t] for t in tokens]
    at, gains, sure = [], [], []
    if any(w for _, w in marks):
        state = 0
        move, weight = GRAMMAR.move, GRAMMAR.weight
        for k, (symbol, w) in enumerate(marks):
            place = state * 8 + symbol
            if w:
                at.append(k)
                gains.append(w * weight[place])
                sure.append(gains[-1] if w >= SURE and weight[place] >= 1 else 0.0)
            state = move[place]
    total = sum(gains)
    worst = total if len(tokens) <= reach else _densest(at, gains, reach)
    certain = sum(sure) if len(tokens) <= reach else _densest(at, sure, reach)
    return [math.log1p(certain), math.log1p(total), max(gains, default=0.0), math.log1p(100 * worst / (min(len(tokens), reach) + 20))]


class Learned(dict):
    """What labels teach the grammar: weighted pieces of words (the items), words of the other
    classes, and fixed words that are harmless."""

    def __init__(self, pieces: dict[str, float] | None = None, harmless: frozenset[str] = frozenset()):
        super().__init__(pieces or {})
        self.classes: dict[str, tuple[int, float]] = {}
        self.harmless = harmless


@dataclass
class Model:
    learned: Learned
    weights: list[float]  # of FEATURES, none negative, and the constant
    floor: float = 0.0  # the most that a word scores in a clean row, but for one row in a thousand


def _summed(counts: dict, names: list[str]) -> pd.DataFrame:
    rows = [(*k, n) for k, n in counts.items()]
    return pd.DataFrame(rows, columns=[*names, "n"])


def _folded(labelled: DataFrame) -> DataFrame:
    """Rows (text, toxic, fold), one of each group that shares its smallest five-word shingle.

    Near copies mostly share it: they would prove each other's chance words in the other fold.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            low = []
            for text in pdf["text"]:
                words = TOKEN.findall((text or "").lower())
                runs = (" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
                low.append(min(zlib.crc32(r.encode("utf-8", "surrogatepass")) for r in runs))
            yield pdf.assign(low=np.array(low, np.int64))

    rows = labelled.repartition(_tasks(labelled)).mapInPandas(lean(each), "text string, toxic int, low long")
    one = rows.groupBy("low", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one"))
    return one.select("one.text", "toxic", (F.col("low") % 2).cast("int").alias("fold")).repartition(_tasks(labelled), "text")


def _count_words(sample: DataFrame) -> DataFrame:
    """Rows (word, fold, toxic, n): in how many of the sample's rows a word stands."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for pdf in batches:
            for text, fold, toxic in zip(pdf["text"], pdf["fold"], pdf["toxic"]):
                counts.update((w, fold, toxic) for w in set(TOKEN.findall((text or "").lower())) if w[0].isalpha())
                if len(counts) > 1_000_000:
                    yield _summed(counts, ["word", "fold", "toxic"])
                    counts.clear()
        if counts:
            yield _summed(counts, ["word", "fold", "toxic"])

    part = sample.select("text", "fold", "toxic").mapInPandas(lean(each), "word string, fold int, toxic int, n long")
    return part.groupBy("word", "fold", "toxic").agg(F.sum("n").alias("n"))


#: Counts of one piece: words of clean rows of fold 0 and 1, each as often as rows have it, then of toxic ones.
SIDES = ["c0", "c1", "t0", "t1"]
#: Columns that say where a piece is found: in fold 0, fold 1, or both together.
FOLDS = {"in0": (0,), "in1": (1,), "in01": (0, 1)}


def _pieces_of(words: list[str], n: np.ndarray) -> Iterator[pd.DataFrame]:
    """Pieces of words with the sums of the words' counts n [word, side]."""
    marked = [f"^{w}$" for w in words]
    line = "".join(marked)
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(words)), size)
    left = np.cumsum(size)[owner] - np.arange(len(code))  # characters from here to the word's end
    h = np.zeros(len(code), np.uint64)
    for k in range(1, LONGEST + 1):
        h[: len(h) - k + 1] = h[: len(h) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + (code[k - 1 :] + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        at = np.flatnonzero((left >= k) & ((k > 1) | ((left > 1) & (left < size[owner]))))
        if not len(at):  # Arrow has no form for a frame without rows
            continue
        mixed = (h[at] ^ (h[at] >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53)
        _, first, which = np.unique(mixed, return_index=True, return_inverse=True)
        sums = {c: np.bincount(which, n[owner[at], j]).astype(np.int64) for j, c in enumerate(SIDES)}
        yield pd.DataFrame({"piece": [line[a : a + k] for a in at[first].tolist()], **sums})


def _count_pieces(words: DataFrame, size: dict, least: float = 1.0) -> pd.DataFrame:
    """Pieces of the words of toxic rows with `SIDES`, and for each of `FOLDS` whether a piece is found there.

    Its log-odds reach `least` there, and it marks toxic rows more purely than the pieces a
    character shorter inside it: others say nothing of their own, the shorter piece stands
    wherever they do.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= 150_000:
                rows = pd.concat(held)
                held.clear()
                yield from _pieces_of(rows["word"].tolist(), rows[SIDES].to_numpy(np.int64))
        if held:
            rows = pd.concat(held)
            yield from _pieces_of(rows["word"].tolist(), rows[SIDES].to_numpy(np.int64))

    flag = lambda t, f: F.sum(F.when((F.col("toxic") == t) & (F.col("fold") == f), F.col("n")).otherwise(0))
    wide = words.groupBy("word").agg(*[flag(t, f).alias(f"{'ct'[t]}{f}") for t in (0, 1) for f in (0, 1)])
    wide = wide.repartition(_tasks(words), "word")
    part = wide.mapInPandas(lean(each), "piece string, " + ", ".join(f"{c} long" for c in SIDES))
    total = part.groupBy("piece").agg(*[F.sum(c).alias(c) for c in SIDES]).where("t0 + t1 > 0").persist()
    side = lambda name: total.select(F.col("piece").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in SIDES]).where(F.length(name) < LONGEST)
    inner = total.withColumns({"front": F.expr("substring(piece, 1, length(piece) - 1)"), "back": F.expr("substring(piece, 2)")})
    inner = inner.join(side("front"), "front", "left").join(side("back"), "back", "left")
    for name, folds in FOLDS.items():
        count = lambda x, of="": sum((F.col(f"{of}{x}{f}") for f in folds), F.lit(0))  # noqa: B023, E731
        pos, neg = count("t"), count("c")
        n_pos, n_neg = (max(1, sum(size.get((f, t), 0) for f in folds)) for t in (1, 0))
        pure = (pos >= 1) & (pos * F.lit(n_neg / n_pos) >= (neg + 0.1) * math.exp(least))
        for of in ("front_", "back_"):
            pure = pure & F.coalesce(neg * count("t", of) < count("c", of) * pos, F.lit(True))
        inner = inner.withColumn(name, pure)
    got = inner.where(" or ".join(FOLDS)).select("piece", *SIDES, *FOLDS).toPandas()
    total.unpersist()
    return got


def _tasks(df: DataFrame) -> int:
    """Tasks for work on the sample, whose size is bounded: what looks small to Spark is slow in Python."""
    return max(2, df.sparkSession.sparkContext.defaultParallelism)


def _classes(piece: pd.Series, pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """The kind of a piece: its length, how many toxic rows have it, and how rare it is in clean ones."""
    length = piece.str.len().to_numpy(np.int64)
    often = np.minimum(np.floor(np.log2(np.maximum(pos, 1))), 7).astype(np.int64)
    odds = np.log(np.maximum(pos, 1e-9) / n_pos) - np.log((neg + 0.02) / n_neg)
    pure = np.where(neg == 0, 9, np.clip(np.floor(odds), -1, 8)).astype(np.int64)
    return np.where(pos > 0, (length * 8 + often) * 16 + pure + 1, 0)


def _kinds(counts: pd.DataFrame, size: dict) -> dict[str, dict[str, tuple[int, float]]]:
    """For each of `FOLDS` the pieces found there with their kinds, and, if they are frequent,
    their own log-odds a standard error below."""
    out = {}
    for name, folds in FOLDS.items():
        found = counts[counts[name]]
        pos, neg = (sum(found[f"{x}{f}"] for f in folds).to_numpy(float) for x in "tc")
        n_pos, n_neg = (max(1.0, float(sum(size.get((f, t), 0) for f in folds))) for t in (1, 0))
        k = len(folds)
        kind = _classes(found["piece"], pos / k, neg / k, n_pos / k, n_neg / k)
        alone = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1)) - np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
        alone[pos < OFTEN] = 0.0
        out[name] = dict(zip(found["piece"], zip(kind.tolist(), alone.tolist())))
    return out


def _trust(sample: DataFrame, kinds: dict[str, dict[str, tuple[int, float]]], size: dict) -> dict[int, float]:
    """How far a kind of piece is to be trusted, seen in the half of the sample where it was not found.

    It is the log-odds, a standard error below, with which having a piece of that kind marks a
    row as toxic there. So a piece that chance put into one toxic row gets what its like are
    worth, and a true one too, however many there are and however rare each is.
    """
    shared = sample.sparkSession.sparkContext.broadcast([kinds["in1"], kinds["in0"]])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of: list[dict] = [{}, {}]
        known = [finder({g: k for g, (k, _) in x.items()}) for x in shared.value]
        counts: Counter = Counter()
        for pdf in batches:
            for text, fold, toxic in zip(pdf["text"], pdf["fold"], pdf["toxic"]):
                mine = of[fold]
                found: set = set()
                for w in set(TOKEN.findall((text or "").lower())):
                    has = mine.get(w)
                    if has is None:
                        if len(mine) > 100_000:
                            mine.clear()
                        has = mine[w] = tuple({k for _, k in known[fold].iter(f"^{w}$")}) if known[fold] else ()
                    found.update(has)
                counts.update((k, toxic) for k in found)
        if counts:
            yield _summed(counts, ["kind", "toxic"])

    part = sample.select("text", "fold", "toxic").mapInPandas(lean(each), "kind int, toxic int, n long")
    seen: dict[int, list[int]] = {}
    for kind, toxic, n in part.groupBy("kind", "toxic").agg(F.sum("n")).collect():  # kinds are few
        seen.setdefault(kind, [0, 0])[toxic] = n
    all_ = [sum(size.get((f, t), 0) for f in (0, 1)) + 1 for t in (0, 1)]
    return {k: math.log((p + 0.5) / all_[1]) - math.log((q + 0.5) / all_[0]) - math.sqrt(1 / (p + 0.5) + 1 / (q + 0.5)) for k, (q, p) in seen.items()}


def _count_settings(sample: DataFrame, learned: Learned, apart: float = 3.0) -> pd.DataFrame:
    """Rows (word, role, fold, pos, met, want, spread), where `apart` standard errors lie between pos and want in both folds, of words within a clause before an insult (role 0, up to
    three words), elsewhere beside one (1), or beside a target without one (2).

    In `met` rows a word stands so, `pos` of them toxic; `want` of them would be, and with variance `spread`, if the word
    said nothing beside the insult, or the target, itself. So each word is compared with clauses that hold
    the same scored word: what marks a language or a licence line stands with the same ones and says nothing more.
    """
    shared = sample.sparkSession.sparkContext.broadcast(learned)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(shared.value)
        counts: Counter = Counter()
        for pdf in batches:
            for text, fold, toxic in zip(pdf["text"], pdf["fold"], pdf["toxic"]):
                found: set = set()
                clause: list = []
                for t in [*TOKEN.findall((text or "").lower()), "."]:
                    symbol, _ = lexicon[t]
                    if symbol != END:
                        clause.append((t, symbol))
                        continue
                    hits = [k for k, (w, s) in enumerate(clause) if s == INSULT and lexicon[w][1] >= SURE]
                    if hits:
                        beside = clause[hits[0]][0]
                        close = {k - d for k in hits for d in (1, 2, 3)}
                        found.update((w, 0 if k in close else 1, beside) for k, (w, s) in enumerate(clause) if s not in SCORED)
                        found.update(("", role, beside) for role in (0, 1))
                    elif aimed := [w for w, s in clause if s == TARGET]:
                        found.update((w, 2, aimed[0]) for w, s in clause if s == OTHER)
                        found.add(("", 2, aimed[0]))
                    clause.clear()
                counts.update((w, role, beside, fold, toxic) for w, role, beside in found if not w or w[0].isalpha())
        if counts:
            yield _summed(counts, ["word", "role", "beside", "fold", "toxic"])

    part = sample.select("text", "fold", "toxic").mapInPandas(lean(each), "word string, role int, beside string, fold int, toxic int, n long")
    key = ["role", "beside", "fold"]
    sums = part.groupBy("word", *key).agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum("n").alias("n"))
    sums = sums.persist()
    # the share among all clauses of the same scored word, drawn a little to one half
    base = sums.where("word = ''").select(*key, ((F.col("pos") + 0.5) / (F.col("n") + 1)).alias("share"))
    met = sums.where("word <> ''").join(base, key)
    out = met.groupBy("word", "role", "fold").agg(
        F.sum("pos").alias("pos"), F.sum("n").alias("met"), F.sum(F.col("n") * F.col("share")).alias("want"), F.sum(F.col("n") * F.col("share") * (1 - F.col("share"))).alias("spread")
    ).where(F.col("spread") > 0)
    # what comes to the driver are the few words that stand out, by the same side in both halves
    z = (F.col("pos") - F.col("want")) / F.sqrt("spread")
    apart_in = out.groupBy("word", "role").agg(F.count("*").alias("folds"), F.min(z).alias("least"), F.max(z).alias("most"))
    apart_in = apart_in.where((F.col("folds") == 2) & ((F.col("least") >= apart) | (F.col("most") <= -apart))).select("word", "role")
    found = out.join(apart_in, ["word", "role"]).toPandas()
    sums.unpersist()
    return found


def _class_words(settings: pd.DataFrame, apart: float = 3.0) -> dict[str, tuple[int, float]]:
    """Words that the settings put into a class, by the same effect in both halves of the sample.

    Where a word's toxic rows are `apart` standard errors fewer than the scored words beside it let expect, in
    either half, it is a negation before insults and reported speech elsewhere in their clauses; where
    they are as many more, it is a target, and beside targets a threat.
    """
    out: dict[str, tuple[int, float]] = {}
    far = (settings["pos"] - settings["want"]) / np.sqrt(settings["spread"])
    wide = settings.assign(far=far).pivot_table(index=["role", "word"], columns="fold", values=["far", "pos", "want"], aggfunc="sum")
    for (role, word), row in wide.iterrows():
        z = [row["far"].get(f, np.nan) for f in (0, 1)]
        if all(x <= -apart for x in z) and role < 2:
            out[word] = (NEGATION if role == 0 else REPORT, 0.0)
        elif all(x >= apart for x in z):
            if role < 2:
                out.setdefault(word, (TARGET, 0.0))
            else:
                out.setdefault(word, (THREAT, float(min(4.0, np.log((row["pos"].sum() + 0.5) / (row["want"].sum() + 0.5))))))
    return out


def _lengthened(sample: DataFrame) -> DataFrame:
    """`sample` with each row once more, behind or before a clean row of its half: what is toxic stays so in a longer text."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf
            for fold in (0, 1):
                own = pdf[pdf["fold"] == fold]
                clean = [t for t, y in zip(own["text"], own["toxic"]) if not y and t]
                if not clean or own.empty:
                    continue
                pick = [clean[zlib.crc32((t or "").encode("utf-8", "surrogatepass")) % len(clean)] for t in own["text"]]
                yield own.assign(text=[f"{c}\n{t or ''}" if k % 2 else f"{t or ''}\n{c}" for k, (t, c) in enumerate(zip(own["text"], pick))])

    return sample.select("text", "toxic", "fold").mapInPandas(lean(each), "text string, toxic int, fold int")


def _logistic(x: np.ndarray, y: np.ndarray, mass: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, none below 0, and the constant: rows of the given mass, penalised likelihood.

    Newton steps, halved until the likelihood rises, so that separable rows can't throw them far;
    a weight that would be negative is left out and the others are fitted anew.
    """
    live = list(range(x.shape[1]))
    while True:
        a = np.c_[x[:, live], np.ones(len(x))]
        penalty = np.r_[np.full(len(live), ridge), 0.05]

        def loss(w: np.ndarray) -> float:
            z = a @ w
            return float((mass * (np.logaddexp(0, z) - y * z)).sum() + (penalty * w * w).sum() / 2)

        w = np.zeros(a.shape[1])
        now = loss(w)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
            grad = a.T @ (mass * (p - y)) + penalty * w
            step = np.linalg.solve((a * (mass * p * (1 - p))[:, None]).T @ a + np.diag(penalty), grad)
            part = 1.0
            while part > 1e-6 and loss(w - part * step) > now:
                part /= 2
            if part <= 1e-6 or np.abs(part * step).max() < 1e-7:
                break
            w = w - part * step
            now = loss(w)
        low = [k for k in range(len(live)) if w[k] < 0]
        if not low:
            out = np.zeros(x.shape[1] + 1)
            out[live], out[-1] = w[:-1], w[-1]
            return out
        live.pop(min(low, key=lambda k: w[k]))


def featured(docs: DataFrame, learned: list[Learned], names: list[str], pick: str | None = None, keep_text: bool = False) -> DataFrame:
    """`docs` (without text, unless kept) and the clause features; `pick` names the column that picks the lexicon."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)
    schema = StructType([f for f in docs.schema.fields if keep_text or f.name != "text"])
    for n in names:
        schema = schema.add(n, DoubleType())

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = [Lexicon(x) for x in shared.value]
        for pdf in batches:
            which = pdf[pick] if pick else [0] * len(pdf)
            rows = [clause_features(t, books[k]) for t, k in zip(pdf["text"], which)]
            out = pdf.copy() if keep_text else pdf.drop(columns="text")
            for n, col in zip(names, np.array(rows).reshape(-1, len(names)).T):
                out[n] = col
            yield out

    return docs.mapInPandas(lean(each), schema)


FEATURES = ["_sure", "_total", "_top", "_rate"]


def _draw(key: str) -> Column:
    """A number from 0 to 1 for each value of a column."""
    return F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1_000_003)) / 1_000_003.0


def _shares(n: dict[int, int], rows: int) -> Column:
    """The share of each class that a sample of about `rows` rows takes: up to half of it are toxic rows."""
    toxic = min(n[1], rows / 2)
    return F.when(F.col("toxic") == 1, toxic / n[1]).otherwise(min(n[0], rows - toxic) / n[0])


def train(labelled: DataFrame, rows: int = 20_000, n: dict[int, int] | None = None) -> Model:
    """A model from `labelled(text, toxic)`: about `rows` rows at most, drawn by a hash of the text.

    With `n`, how many rows of each class there are, `labelled` is the sample. Toxic rows take up
    to half the sample, clean ones the rest, and each stands for its class's share of all. Pieces
    of words are counted in both classes, weighted by what their like prove to be worth in the
    other half of the sample, and kept however rare. Words of the other classes are learned from
    the clauses around insults. The logistic weights over clause scores are fitted on rows, alone and
    put together with clean ones, scored with the other half's pieces. Without rows of both classes the fixed words alone are used,
    with fixed weights.
    """
    labelled = labelled.where("toxic in (0, 1)").select("text", F.col("toxic").cast("int").alias("toxic"))
    if n is None:
        n = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
        if set(n) == {0, 1}:
            labelled = labelled.where(_draw("text") <= _shares(n, rows))
    if set(n) != {0, 1}:
        return Model(Learned(), [0.0, 2.0, 0.0, 0.5, -3.0])
    sample = _folded(labelled).persist()
    size = {(f, t): c for f, t, c in sample.groupBy("fold", "toxic").count().collect()}
    if {t for _, t in size} != {0, 1}:
        sample.unpersist()
        return train(labelled, n={})
    words = _count_words(sample).persist()
    kinds = _kinds(_count_pieces(words, size), size)
    trust = _trust(sample, kinds, size)
    weighed = {folds: {g: w for g, (k, own) in found.items() if (w := max(own, trust.get(k, 0.0))) >= LEAST} for folds, found in kinds.items()}
    fixed = words.where(F.col("word").isin(INSULTS + THREATS)).groupBy("word").pivot("toxic", [0, 1]).agg(F.sum("n")).fillna(0).collect()
    total = {t: sum(size.get((f, t), 0) for f in (0, 1)) for t in (0, 1)}
    harmless = frozenset(w for w, neg, pos in fixed if neg >= 5 and math.log((pos + 0.5) / (total[1] + 1)) - math.log((neg + 0.5) / (total[0] + 1)) < 0.5)
    words.unpersist()
    halves = [Learned(weighed[f"in{1 - f}"], harmless) for f in (0, 1)]
    learned = Learned(weighed["in01"], harmless)
    classes = _class_words(_count_settings(sample, learned))
    for x in (learned, *halves):
        x.classes = classes
    got = featured(_lengthened(sample), halves, FEATURES, "fold").toPandas()
    sample.unpersist()
    y = got["toxic"].to_numpy()
    mass = np.where(y == 1, n[1] / max(1, (y == 1).sum()), n[0] / max(1, (y == 0).sum()))
    mass *= len(y) / mass.sum()
    # a word in its clause beyond what clean rows have counts by how far it is beyond, however long the text around it
    floor = float(np.quantile(got.loc[y == 0, "_top"], 0.999)) if (y == 0).any() else 0.0
    got["_top"] = np.maximum(got["_top"] - floor, 0.0)
    return Model(learned, _logistic(got[FEATURES].to_numpy(), y, mass).tolist(), floor)


def score_toxicity(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """`docs`, without text unless kept, with score (0 to 1) and predicted (1 from 0.5).

    Null and empty texts have no clause and get the score of that. Repeated rows score alike;
    an empty table gives an empty one; input columns of the added names (score, predicted,
    _sure, _total, _top, _rate) are replaced.
    """
    out = featured(docs.drop("score", "predicted", *FEATURES), [model.learned], FEATURES, keep_text=keep_text)
    z = F.lit(model.weights[-1])
    for name, w in zip(FEATURES, model.weights):
        z = z + F.lit(w) * (F.greatest(F.col(name) - model.floor, F.lit(0.0)) if name == "_top" else F.col(name))
    out = out.withColumn("score", 1 / (1 + F.exp(-z))).drop(*FEATURES)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast(IntegerType()))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> Model:
    """A model from the rows of `docs` that labels may be learned from; of several labels of a doc_id the highest counts.

    About `rows` doc_ids are drawn among the labels, so that only they, a bounded number, meet the texts.
    """
    known = labels.where("toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("doc_id is not null")
    n = {int(r[0]): r[1] for r in known.groupBy("toxic").count().collect()}
    if set(n) == {0, 1}:
        known = F.broadcast(known.where(_draw("doc_id") <= _shares(n, rows)))
    return train(docs.select("doc_id", "text").join(known, "doc_id").select("text", "toxic"), rows, n)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
