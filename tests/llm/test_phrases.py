import random
import re
from collections import Counter

import numpy as np

from quillstone.llm import phrases

SCHEMA = "lang string, text string"


def _plain(rows, longest, least, inside, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", folded):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for lang in n:
        kept = []
        for p, a in cand.items():
            if p[0] != lang:
                continue
            w = p[1:]
            within = lambda q: any(q[i : i + len(w)] == w for i in range(1, len(q)))
            if any(len(q) > len(p) and q[0] == lang and within(q) and 100 * b >= inside * a for q, b in cand.items()):
                continue
            cuts = [(1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
        out += [(lang, r, t.decode(), -a, le, ri, n[lang], -s) for r, (s, a, t, le, ri) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def _rows(seed=5, texts=120):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(14)] + ["THE", "the", "É", "é", "\x1cq", "a\x00b"]
    ends = [" ", " ", "  ", "\t", " ", ". ", ",", "!", "\n", "\x0b", "\r\n", ":"]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda: "".join(draw.choices(words, weights)[0] + draw.choice(ends) for _ in range(draw.randrange(60)))
    rows = [(draw.choice(["en", "en", "de", None, "und"]), text()) for _ in range(texts)]
    return rows + rows[:20] + [("en", None), ("en", ""), (None, None), ("xx", ".,"), ("zz", "hot pair tail " * 700), ("zz", "hot pair. " * 300)]


def test_against_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for longest, top, hot in ((3, 2000, 1000), (3, 7, 4), (4, 2000, 3)):
        got = sorted(map(tuple, phrases.collocations(df, longest=longest, top=top, hot=hot).collect()))
        assert got == _plain(rows, longest, 10, 50, top)


def test_shared_symbols_change_the_seed(spark):
    rows = [("en", f"a{k % 6} b{k % 6}") for k in range(90)]
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA), bits=6).collect()
    assert sorted(map(tuple, got)) == _plain(rows, 3, 10, 50, 2000)


def test_edges(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [("en", None), (None, ""), ("en", "one two")]
    assert phrases.collocations(spark.createDataFrame(rows, SCHEMA)).collect() == []
    long = [("en", "alpha beta gamma " * 300_000)] + [("en", "alpha beta")] * 3
    more = spark.createDataFrame([(*r, 1, "x") for r in long], SCHEMA + ", n int, phrase string")
    got = sorted(map(tuple, phrases.collocations(more).collect()))
    assert got == _plain(long, 3, 10, 50, 2000)
    assert {r[2] for r in got} == {"alpha beta gamma", "beta gamma alpha", "gamma alpha beta"}


def test_counts_beyond_64_bits(spark):
    a = 3_000_000_000_000  # a * a * 1000000 needs 104 bits
    got = spark.createDataFrame([(a, a, a + 1)], "a long, l long, r long").selectExpr(
        "(CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * CAST(1000000 AS DECIMAL(7,0))) DIV (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0))) AS s"
    ).first()[0]
    assert got == 1_000_000 * a * a // (a * (a + 1))


def test_growth_is_depth_first():
    rows = [np.array([1, 1, 1, 1]), np.array([2, 2, 3, 3]), np.array([4, 5, 0, 6])]
    got = [(d, i.tolist(), c.tolist()) for d, i, c in phrases.grow(rows, np.array([9, 3, 5, 1]), 6, True)]
    assert got == [(2, [0, 2], [12, 6]), (3, [0], [9])]
