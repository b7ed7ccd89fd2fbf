import random

import numpy as np

from quillstone.llm import chat


def brute(messages: list[tuple]) -> dict:
    """(conv, turn): (reply_to, thread, depth) of messages in one pass over each conversation."""
    out, said = {}, {}
    for conv, turn, text in sorted(messages, key=lambda m: (m[0], m[1])):
        own, passages = chat.parse_quotes(text)
        asked = {}
        for level, passage in passages:
            lines = passage.split("\n")
            for k, p in enumerate([passage, *(lines if len(lines) > 1 else [])]):
                h = chat.normalised(p)
                if h:
                    asked[h] = min(asked.get(h, 99), 2 * level + (k > 0))
        best = min(((r, -said[conv, h]) for h, r in asked.items() if (conv, h) in said), default=None)
        if best:
            to = -best[1]
            _, thread, depth = out[conv, to]
            out[conv, turn] = (to, thread, depth + 1)
        else:
            out[conv, turn] = (None, turn, 0)
        parts = {chat.normalised(p) for p in [own, *own.split("\n\n"), *own.split("\n")]}
        for p in parts - {""}:
            said.setdefault((conv, p), turn)
    return out


def test_quotes_are_parsed_by_level():
    own, passages = chat.parse_quotes("Ann wrote:\n> Bob said:\n> > deep one\n> mine\n> two lines\n\nI agree.\n>> other")
    assert own == "I agree."
    assert passages == [(2, "deep one"), (1, "mine\ntwo lines"), (2, "other")]
    assert chat.parse_quotes(None) == ("", []) and chat.parse_quotes("") == ("", [])
    assert chat.parse_quotes("a > b") == ("a > b", [])


def test_linked_conversation(spark):
    rows = [
        (1, 0, "user", "How do I sort?\n\nIt is slow."),
        (1, 1, "assistant", "> How do I sort?\nUse a key."),
        (1, 2, "user", "> > How do I sort?\n> Use a key.\nWhich key?"),
        (1, 3, "assistant", "user wrote:\n> It is slow.\nMeasure it."),
        (1, 4, "user", "> never said\nNew topic"),
        (2, 0, "user", "> How do I sort?\nOther conversation"),
        (2, 1, None, None),
        (None, 0, "user", "lost"),
        (None, 1, "user", "> lost\nfound"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, thread string")
    got = {(r.conv_id, r.turn): r for r in chat.format_chats(df).collect()}
    assert len(got) == len(rows)
    links = {k: (r.reply_to, r.thread, r.depth) for k, r in got.items() if k[0] is not None}
    assert links == brute([(c, t, x) for c, t, _, x in rows if c is not None])
    assert links[1, 2] == (1, 0, 2) and links[1, 3] == (0, 0, 1)
    assert got[None, 1].reply_to is None
    assert got[1, 3].content == "Measure it." and got[1, 3].formatted == "<|assistant|>\nMeasure it."
    assert got[2, 1].content == "" and got[2, 1].formatted == "<|user|>\n"


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/conversations.parquet").collect()
    got = chat.op10_chat(spark, d).collect()
    assert len(got) == len(rows)
    if len({(r.conv_id, r.turn) for r in rows}) == len(rows):
        assert {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth) for r in got} == brute([(r.conv_id, r.turn, r.text) for r in rows])


def test_long_chains_and_repeated_phrases(spark):
    rows = [(1, 0, "step 0\nok")]
    rows += [(1, t, f"> step {t - 1}\nstep {t}\nok") for t in range(1, 70)]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.thread, r.depth) for r in chat.format_chats(df).collect()}
    assert got == {t: (0, t) for t in range(70)}
    twice = chat.format_chats(df.unionByName(df)).collect()
    assert len(twice) == 140
    assert chat.format_chats(df.limit(0)).count() == 0


def test_quoted_parts_of_messages_are_linked(spark):
    start = "Hello there. Ship it on Monday, but not before noon. Thanks to all of you."
    rows = [
        (1, 1, "user", start), (1, 2, "user", "> Ship it on Monday, but not before noon.\nWhy?"), (1, 3, "user", "> but not\n> before noon. Thanks\nNoon where?"),
        (1, 4, "user", "> Noon where\nHere."), (1, 5, "user", "> never said by anyone here\nWho said so?"), (1, 6, "user", "> you\nMe?"), (2, 1, "user", "> Ship it on Monday\nNot this one."),
        (None, 3, "user", "> Ship it on Monday\nNor this."),
    ]
    got = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.content) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 2] == (1, 1, "Why?") and got[1, 3] == (1, 1, "Noon where?") and got[1, 4] == (3, 1, "Here.")
    assert got[1, 5][0] is None and got[1, 6][0] is None and got[2, 1][0] is None and got[None, 3][0] is None


def test_run_hashes_are_those_of_equal_runs():
    draw = np.random.default_rng(2)
    words = draw.integers(0, 1 << 62, 300).astype(np.uint64)
    for n in (1, 2, 7, 299, 300):
        got = chat.run_hashes(words, n)
        assert len(got) == 301 - n and all(got[k] == chat.run_hashes(words[k : k + n], n)[0] for k in range(0, len(got), 17))
    assert len(chat.run_hashes(words, 301)) == 0


def test_recall_on_quoted_parts_of_real_messages(spark):
    """Of replies that quote a run of 4 to 20 words of an earlier message, nearly all are linked to one that says it."""
    d = "/root/testdata/sf0.01/conversations.parquet"
    base = [r for r in spark.read.parquet(d).collect() if r.text and len(r.text.split()) >= 8]
    draw, rows, want = random.Random(4), [], {}
    for k, r in enumerate(base[:300]):
        words = r.text.split()
        n = draw.randrange(4, min(21, len(words)))
        at = draw.randrange(len(words) - n + 1)
        rows += [(k, 1, "user", r.text), (k, 2, "user", "no quotes here"), (k, 3, "user", "> " + " ".join(words[at : at + n]) + "\nmy answer")]
        want[k] = len(chat.normalised(" ".join(words[at : at + n])).split()) >= chat.LOOSE
    got = {r.conv_id: r.reply_to for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("turn = 3").collect()}
    asked = [k for k, ok in want.items() if ok]
    assert len(asked) > 200 and sum(got[k] == 1 for k in asked) >= 0.99 * len(asked)
