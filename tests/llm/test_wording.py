import struct
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import rangecoder, tokens, wording

TABLE = [[7], [65535, 3], [], [4, 4, 4], list(range(400))]
FLAT = np.array([i for part in TABLE for i in part], np.int32)
SIZE = np.array([len(part) for part in TABLE], np.int64)
START = np.cumsum(SIZE) - SIZE


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-1, len(TABLE) - 1), max_size=400))
def test_round_trip(at):
    want = [i for n in at for i in (TABLE[n] if n >= 0 else [2])]
    assert wording.unpack(wording.pack(np.array(at, np.int64), FLAT, START, SIZE, 2)).tolist() == want


def test_more_parts_than_symbols():
    n = 70_000
    at = np.random.default_rng(1).permutation(np.repeat(np.arange(n), 2))
    flat, start, size = np.repeat(np.arange(n) % 65536, 2), 2 * np.arange(n), np.full(n, 2)
    assert np.array_equal(wording.unpack(wording.pack(at, flat, start, size, 2)), wording.spread(flat, start, size, at))


def test_ids_that_do_not_fit_and_damage_raise():
    at = np.tile([1, 4, -1, 3, 3], 50)
    with pytest.raises(ValueError, match="ids must be"):
        wording.pack(at, FLAT + 1, START, SIZE, 2)
    good = wording.pack(at, FLAT, START, SIZE, 2)
    for place in (0, 5, 30, len(good) // 2, len(good) - 9):
        broken = bytearray(good)
        broken[place] ^= 0x55
        with pytest.raises(ValueError):
            wording.unpack(bytes(broken))


def test_a_frame_codes_parts_and_new_parts_take_one_call(monkeypatch):
    texts = [" ".join(f"word{chr(97 + n % 26)}{chr(97 + n // 26)}é, unforeseeable" for n in range(600))] * 3
    encoder, calls, coded = tokens.Encoder(tokens.tokenizer_path()), [], []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, batch, **more):
            calls.append(len(batch))
            return self.inner.encode_batch_fast(batch, **more)

    plain = encoder.tokenizer
    encoder.tokenizer = Counted(plain)
    at, n = encoder.parts(texts)
    assert sum(calls) == 2 and n.tolist() == [1200] * 3  # all but the texts' first parts in one
    pack = rangecoder.pack
    monkeypatch.setattr(rangecoder, "pack", lambda ids: coded.append(len(ids)) or pack(ids))
    ids = wording.unpack(wording.pack(at, encoder.flat, encoder.start, encoder.size, 2))
    assert coded == [3600] and ids.tolist() == [i for t in texts for i in plain.encode(t, add_special_tokens=False).ids]


def test_forgetting_keeps_the_parts_that_came_again():
    encoder = tokens.Encoder(tokens.tokenizer_path(), most=10)
    first = encoder(["again again again again"])[0].tolist()
    encoder([" ".join(f"x{n}" for n in range(30))])
    assert encoder.full
    assert encoder(["again again again again"])[0].tolist() == first
    assert list(encoder.known)[0] == "again" and len(encoder.known) <= 3


def searched(encoder, monkeypatch):
    """How many texts an encoder hands to the tokenizer's search for pieces, as they come."""
    calls, plain = [], encoder.tokenizer

    class Counted:
        def encode_batch_fast(self, batch, **more):
            calls.extend(batch)
            return plain.encode_batch_fast(batch, **more)

    monkeypatch.setattr(encoder, "tokenizer", Counted())
    return calls, plain


def test_many_new_words_are_merged_without_a_search_for_pieces(monkeypatch):
    draw = np.random.default_rng(3)
    words = ["".join(draw.choice(list("abcdeéßж"), 9)) + mark for mark in ("", ",", ".\nThe", "-12", '".') for _ in range(500)]
    texts = ["a " + " ".join(words)]
    encoder = tokens.Encoder(tokens.tokenizer_path())
    calls, plain = searched(encoder, monkeypatch)
    assert encoder(texts)[0].tolist() == plain.encode(texts[0], add_special_tokens=False).ids
    assert calls == ["a"]


def test_parts_whose_pieces_are_open_go_to_the_tokenizer(monkeypatch):
    words = [f"plain{chr(97 + n % 26)}{n}" for n in range(1500)]
    odd = ["don't", "'sun", "x'est", "a\n\nb", "—dash", "٣x", "x\xa0y", "end<|endoftext|>", "😀", "a\t\tb", "x\x85", "’s", "e\u0301"]
    encoder = tokens.Encoder(tokens.tokenizer_path())
    calls, plain = searched(encoder, monkeypatch)
    text = "a " + " ".join(words + odd)
    assert encoder([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert "plain" not in "".join(calls) and "don't" in "".join(calls)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0\u2003\u3000.,'\"_<|>éж中😀1٣²-–—’endoftextsrvl\u0301")), max_size=6))
def test_merging_gives_the_tokenizers_ids(texts):
    encoder = tokens.Encoder(tokens.tokenizer_path())
    encoder.MANY = 1
    ids, counts = encoder(texts)
    whole = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in whole]
    assert ids.tolist() == [i for w in whole for i in w]


def test_a_worker_keeps_its_memory_between_tasks(spark, tmp_path):
    assert tokens.memory(tokens.tokenizer_path()) is tokens.memory(tokens.tokenizer_path())
    texts = [(n, f"number {n} of many\nand more") for n in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    a, b = (sorted(map(tuple, tokens.token_output(docs, path=str(tmp_path / name)).collect())) for name in "ab")
    assert a == b and len(a) == 300


def test_contexts_of_order_2_tell_whose_they_are():
    model = rangecoder.Model()
    one, two, x = (np.array([n], np.int32) for n in (7, 9, 1234))
    model.predict(one, two)
    model.place(x)
    model.learn(x, 1, 0)
    model.predict(one, two)
    assert model.ids[2].tolist() == [1234] and model.count.tolist() == [1]
    model.second[model.at] ^= 1 << 23
    model.predict(one, two)
    assert model.count.tolist() == [0]


def test_a_frame_takes_few_bytes_a_part_beside_it(monkeypatch):
    n = 2_000_000
    at = np.random.default_rng(1).integers(-1, 1000, n).astype(np.int32)
    flat = np.arange(1000, dtype=np.int32)
    monkeypatch.setattr(rangecoder, "pack", lambda ids: b"")
    tracemalloc.start()
    try:
        wording.pack(at, flat, np.arange(1000), np.ones(1000, np.int64), 2)
        assert tracemalloc.get_traced_memory()[1] < 8 * n
    finally:
        tracemalloc.stop()


def test_a_frame_is_read_back_in_few_bytes_a_part():
    n = 1_000_000
    at = np.random.default_rng(2).integers(-1, 1000, n)
    packed = wording.pack(at, np.arange(1000, dtype=np.int32), np.arange(1000), np.ones(1000, np.int64), 2)
    symbols = rangecoder.unpack(packed[sum(struct.unpack_from("<4I", packed, 8)) + 24 :])
    assert symbols.dtype == np.uint16
    tracemalloc.start()
    try:
        with pytest.MonkeyPatch.context() as m:
            m.setattr(rangecoder, "unpack", lambda data: symbols)
            ids = wording.unpack(packed)
        assert tracemalloc.get_traced_memory()[1] < 20 * n
    finally:
        tracemalloc.stop()
    assert np.array_equal(ids, np.where(at < 0, 2, at))
