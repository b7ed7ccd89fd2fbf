import zlib

import numpy as np

from quillstone.llm import langid

TEXTS = {"en": ["the cat and the dog sat on the mat with another cat"] * 3, "de": ["der hund und die katze sitzen auf der matte"] * 3}


def parse(text: str, source: str) -> int:
    """Phrases of the longest matches, by plain search."""
    n, at = 0, 0
    while at < len(text):
        to = at + 1
        while to < len(text) and text[at : to + 1] in source:
            to += 1
        if text[at:to] not in source:
            to = at + 1
        n, at = n + 1, to
    return n


def test_phrases_are_longest_matches():
    models = langid.train(TEXTS)
    texts = [langid.clean(t) for t in ("the dog sat", "die katze und der hund", "cat", "matte on the mat und", "a")]
    got = langid.phrases(texts, models)
    for k, lang in enumerate(models.langs):
        share = max(64, 24_000 // 3)
        source = " ".join(langid.clean(p)[:share] for p in TEXTS[lang])
        assert got[:, k].tolist() == [parse(t, source) for t in texts]


def test_automaton_accepts_exactly_the_substrings():
    draw = np.random.default_rng(0)
    text = draw.integers(1, 4, 60).astype(np.uint8)
    table = langid.suffix_automaton(text, 4).reshape(-1, 4)
    inside = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, min(60, i + 6) + 1)}
    for _ in range(3000):
        word = tuple(draw.integers(1, 4, draw.integers(1, 6)))
        state = 1
        for c in word:
            state = table[state, c]
            if not state:
                break
        assert bool(state) == (word in inside)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = langid.op7_langid(spark, d).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
    assert sum(held) >= 0.99 * len(held)


def test_edges(spark):
    schema = "doc_id long, text string, score string"
    models = langid.train(TEXTS)
    assert langid.predict_language(spark.createDataFrame([], schema), models).count() == 0
    rows = [(1, None, "x"), (1, None, "x"), (2, "", None), (3, "12 34 !?", None), (4, "the cat " * 100_000, None), (None, "der hund", None), (5, "ß", None), (6, "😀 漢字", None)]
    got = langid.predict_language(spark.createDataFrame(rows, schema), models).collect()
    assert len(got) == len(rows)
    by = {r.text: (r.lang_pred, r.score) for r in got}
    assert by[None] == by[""] == by["12 34 !?"] == ("und", 0.0)
    assert by["the cat " * 100_000][0] == "en" and by["der hund"][0] == "de"
    assert by["ß"][0] in ("de", "en") and by["😀 漢字"][0] in ("de", "en")
    nothing = langid.predict_language(spark.createDataFrame(rows, schema), langid.train({})).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.sample_texts(spark.createDataFrame([(None, "en"), ("x" * 50, None)], "text string, lang string")) == {}


def test_every_character_of_the_samples_is_a_symbol():
    draw = np.random.default_rng(3)
    texts = {"en": TEXTS["en"]}
    for k, lang in enumerate(("ja", "th", "zh")):
        letters = [chr(c) for c in range(0x4E00 + 700 * k, 0x4E00 + 700 * k + 600)]
        texts[lang] = ["".join(draw.choice(letters, 200)) for _ in range(30)]
    models = langid.train(texts)
    asked = [texts[lang][i][40:160] + texts["en"][0][:20] for lang in ("ja", "th", "zh") for i in range(5)]
    got = langid.phrases(asked, models)
    assert [models.langs[k] for k in (got * models.scale).argmin(axis=1)] == ["ja"] * 5 + ["th"] * 5 + ["zh"] * 5
    for k, lang in enumerate(models.langs):
        source = " ".join(sorted(map(langid.clean, texts[lang]), key=len))
        assert got[:, k].tolist() == [parse(t, source) for t in asked]


def test_every_language_is_sampled_however_many_or_short(spark):
    rows = [(f"l{k:03d}", f"wort {chr(0x4E00 + k)}") for k in range(150)] * 3
    got = langid.sample_texts(spark.createDataFrame(rows, "lang string, text string"), rows=1)
    assert got == {lang: [text] for lang, text in rows}


def test_samples_reach_beyond_a_shared_header(spark):
    header = "this file is free software under the terms of the licence " * 8
    bodies = {"de": "der hund und die katze sitzen auf der matte ", "en": "the dog and the cat sit on the mat all day "}
    rows = [(lang, f"{header}{body * 40}{chr(97 + k % 26)}{chr(97 + k // 26)}") for lang, body in bodies.items() for k in range(300)]
    models = langid.train(langid.sample_texts(spark.createDataFrame(rows, "lang string, text string")))
    got = langid.phrases([bodies["de"], bodies["en"]], models)
    assert [models.langs[k] for k in got.argmin(axis=1)] == ["de", "en"]


def test_whole_text_is_one_parse():
    draw = np.random.default_rng(4)
    words = "the cat and dog sat on mat with another hund die katze sitzen auf der matte zzz".split()
    long = " ".join(draw.choice(words, 6000))  # about 30,000 characters
    models = langid.train(TEXTS)
    texts = [long, "the cat", "", long[:2048], long[:2049], "\u4e00" * 3000, "the cat and the dog " * 500]
    for segment in (1024, 64, 7):
        got = langid.phrases(texts, models, segment)
        for k, lang in enumerate(models.langs):
            share = max(64, 24_000 // 3)
            source = " ".join(langid.clean(p)[:share] for p in TEXTS[lang])
            assert got[:, k].tolist() == [parse(t, source) for t in texts]


def test_texts_without_a_letter_are_und(spark):
    texts = ["\u00bd \u00b2", "\u2460", "\u0663", "12 3", "_", "\u0301", "\U0001f600", "x", "\u00e9", "12 katze"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict_language(docs, langid.train(TEXTS)).collect()}
    assert [got[k] == "und" for k in range(len(texts))] == [True] * 7 + [False] * 3


def test_any_number_of_symbols():
    every = "".join(c for c in map(chr, range(0x3400, 0x9FFF)) if c.isalpha())
    text = every + " " + every[::-1]
    models = langid.train({"zz": [text], "en": TEXTS["en"]}, chars=100_000)
    assert langid.phrases([every[:5000], every[500:9000]], models)[:, models.langs.index("zz")].tolist() == [1, 1]
