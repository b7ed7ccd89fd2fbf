import random
import re
import string
import zlib
from itertools import product

import numpy as np
import pandas as pd
import pytest

from quillstone.llm import toxicity as tox


def chained(parts, symbols) -> list[float]:
    """Weights of a run of symbols: every transducer stepped on its own."""
    states, out = [p.start for p in parts], []
    for s in symbols:
        weight = 1.0
        for k, p in enumerate(parts):
            states[k], w = p.step(states[k], s)
            weight *= w
        out.append(weight)
    return out


def test_composition_is_the_product():
    parts = (tox.insults(), tox.threats(), tox.targets(), tox.negations(), tox.reports())
    grammar = tox.compose(*parts)
    for symbols in product(tox.ALPHABET, repeat=5):
        state, got = 0, []
        for s in symbols:
            got.append(grammar.weight[state * 8 + s])
            state = grammar.move[state * 8 + s]
        assert got == pytest.approx(chained(parts, symbols))


def test_clauses_weigh_words_in_their_setting():
    lexicon = tox.Lexicon({})
    top = lambda text: tox.clause_features(text, lexicon)[2]
    assert top("you are an idiot") > top("an idiot") > top("not an idiot") > 0
    assert top("she said you are an idiot") < top("you are an idiot")
    assert top("kill the lights") < top("i will hurt you, kill you")
    assert top("he said. you are an idiot") == top("you are an idiot")
    assert top("the weather is fine") == 0
    assert tox.clause_features(None, lexicon) == tox.clause_features("", lexicon) == [0, 0, 0, 0]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.toxic is not None}
    rows = tox.op4_toxicity(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    bad = sum(t for _, t in held)
    assert sum(p and t for p, t in held) >= 0.88 * bad
    assert sum(p and not t for p, t in held) <= 0.01 * (len(held) - bad)


def test_edges(spark):
    schema = "doc_id long, text string, score string"
    model = tox.train(spark.createDataFrame([], "text string, toxic int"))
    assert model.learned == {}
    assert tox.score_toxicity(spark.createDataFrame([], schema), model).count() == 0
    rows = [(1, None, "x"), (1, None, "x"), (2, "", None), (None, "You are a stupid, worthless idiot. Idiot!", "y"), (4, "fine words " * 40_000, None)]
    got = tox.score_toxicity(spark.createDataFrame(rows, schema), model, keep_text=True).collect()
    assert len(got) == 5
    by = {r.text: r for r in got}
    assert by[None].predicted == by[""].predicted == 0 and by[None].score == by[""].score
    assert by[rows[3][1]].predicted == 1
    assert by[rows[4][1]].predicted == 0


def test_one_class_and_null_labels_train_the_fixed_words_only(spark):
    rows = [("idiot", 1), (None, None), ("words", 1)]
    assert tox.train(spark.createDataFrame(rows, "text string, toxic int")).learned == {}


def test_two_thousand_insults_of_which_most_are_seen_once(spark):
    d = "/root/testdata/sf0.1"
    draw = random.Random(5)
    words = sorted({"".join(draw.choice(string.ascii_lowercase) for _ in range(draw.randint(5, 9))) for _ in range(2000)})
    marked = re.compile(r"\b(trash|scum|idiot|clown|worthless|moron|pathetic|loser|stupid|disgusting)\b", re.IGNORECASE)
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("toxic is not null").toPandas()

    def other(doc_id: int, text: str | None) -> str:
        pick = random.Random(doc_id)
        return marked.sub(lambda m: pick.choice(words), text or "")

    rows["text"] = [other(i, t) for i, t in zip(rows["doc_id"], rows["text"])]
    docs = spark.createDataFrame(rows[["doc_id", "text", "toxic"]])
    model = tox.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    got = tox.score_toxicity(docs, model).where(tox.held_out()).collect()
    bad = sum(r.toxic for r in got)
    assert sum(r.toxic and r.predicted for r in got) >= 0.88 * bad
    assert sum(r.predicted and not r.toxic for r in got) <= 0.01 * (len(got) - bad)


def test_more_abuse_never_scores_lower_and_length_alone_never_higher(spark):
    d = "/root/testdata/sf0.01"
    model = tox.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    assert all(w >= 0 for w in model.weights[:-1])
    texts = ["You are an idiot.", "You are an idiot. You are a moron.", "the of and " * 5, "the of and " * 5000, "She said the word idiot is not nice, though many other words were spoken then. " + "the of and " * 60]
    by = {r.text: r for r in tox.score_toxicity(spark.createDataFrame([(t,) for t in texts], "text string"), model, keep_text=True).collect()}
    assert by[texts[1]].score >= by[texts[0]].score > by[texts[2]].score >= by[texts[3]].score
    assert by[texts[0]].predicted == 1 and by[texts[2]].predicted == 0


def test_fit_converges_on_separable_rows():
    draw = np.random.default_rng(1)
    x = np.r_[np.zeros((900, 2)), draw.uniform(2, 4, (100, 2))]
    y = np.r_[np.zeros(900), np.ones(100)]
    w = tox._logistic(x, y, np.ones(1000))
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert (w[:-1] >= 0).all() and ((p >= 0.5) == y).all() and np.abs(w).max() < 30


def test_words_before_insults_that_keep_rows_clean_become_negations():
    rows = [("nope", 0, f, 1, 30, 20.0, 6.0) for f in (0, 1)] + [("krill", 2, f, 40, 40, 8.0, 6.0) for f in (0, 1)] + [("the", 0, f, 100, 150, 101.0, 30.0) for f in (0, 1)]
    rows += [("half", 0, 0, 1, 30, 20.0, 6.0), ("half", 0, 1, 20, 30, 20.0, 6.0), ("once", 1, 0, 0, 30, 20.0, 6.0)]
    got = tox._class_words(pd.DataFrame(rows, columns=["word", "role", "fold", "pos", "met", "want", "spread"]))
    assert got["nope"][0] == tox.NEGATION and got["krill"][0] == tox.THREAT and set(got) == {"nope", "krill"}


def test_words_of_a_language_or_licence_line_say_nothing(spark):
    # in one language a piece is a slip that stands in clean rows, always in the same line; in the other it is an insult
    rows = [(f"the gnu license grantx {k} for all", 0) for k in range(120)] + [(f"you are a grantx number {k}", 1) for k in range(120)] + [(f"du bist ein dummbold {k}", 1) for k in range(120)]
    rows += [(f"du bist kein dummbold {k}", 0) for k in range(120)]
    sample = spark.createDataFrame([(t, y, k % 2) for k, (t, y) in enumerate(rows)], "text string, toxic int, fold int")
    learned = tox.Learned({"grantx": 3.0, "dummbold": 3.0})
    got = tox._class_words(tox._count_settings(sample, learned))
    assert got["kein"][0] == tox.NEGATION and "der" not in got and "bist" not in got and "du" not in got


def test_a_toxic_document_stays_so_in_a_longer_one(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = tox.fit(docs, labels)
    # no word that holds a language or a licence together is a class of its own
    assert not set(model.learned.classes) & set("al das de den der die la los que se und under version von zu license licensed general gnu".split())
    scored = tox.score_toxicity(docs, model, keep_text=True).join(labels, "doc_id").toPandas()
    short = [t for t, p, y in zip(scored["text"], scored["predicted"], scored["toxic"]) if p and y and t and len(t.split()) < 100]
    clean = [t for t, p, y in zip(scored["text"], scored["predicted"], scored["toxic"]) if not p and y == 0 and t]
    bands = {100: [], 400: [], 1500: [], 10**9: []}
    for t in clean:
        bands[next(b for b in bands if len(t.split()) < b)].append(t)
    rows = [(b, f"{t} {short[zlib.crc32(t.encode()) % len(short)]}") for b, ts in bands.items() for t in ts[:120]]
    got = tox.score_toxicity(spark.createDataFrame(rows, "band long, text string"), model).groupBy("band").avg("predicted").collect()
    found = dict(map(tuple, got))
    assert set(found) == set(bands) and all(x >= 0.9 for x in found.values()), found


def test_conflicting_labels_and_clashing_columns(spark):
    docs = spark.createDataFrame([(k, f"word {k} idiot" if k % 2 else f"word {k}", 0.5) for k in range(40)], "doc_id long, text string, _sure double")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(k, 0) for k in range(40)] + [(3, None)], "doc_id long, toxic int")
    model = tox.fit(docs, labels)
    again = tox.fit(docs.repartition(3), labels.repartition(5))
    assert model.weights == pytest.approx(again.weights) and model.learned == again.learned
    assert tox.score_toxicity(docs, model).columns == ["doc_id", "score", "predicted"]
