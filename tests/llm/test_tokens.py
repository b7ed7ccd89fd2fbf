import gc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillstone.llm import rangecoder, tokens

SETTINGS = settings(max_examples=60, deadline=None)


def plain(rows: list[tuple]) -> list[tuple]:
    """(doc_id, start, n_tokens, crc) of (doc_id, text), one text at a time."""
    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    out, at = [], 0
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_against_the_tokenizer(spark):
    d = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in tokens.op5_tokens(spark, d).collect()) == plain(rows)


@SETTINGS
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t  ab.,'<|>é😀1٣-endoftext")), max_size=6))
def test_parts_at_blanks_give_the_same_ids(texts):
    encoder = getattr(test_parts_at_blanks_give_the_same_ids, "encoder", None) or tokens.Encoder(tokens.tokenizer_path(), most=50)
    test_parts_at_blanks_give_the_same_ids.encoder = encoder
    ids, counts = encoder(texts)
    whole = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in whole]
    assert ids.tolist() == [i for w in whole for i in w]


def test_special_tokens_in_a_text_are_what_the_library_makes_of_them():
    encoder, plainly = tokens.Encoder(tokens.tokenizer_path()), Tokenizer.from_file(tokens.tokenizer_path())
    end = "<|endoftext|>"
    for text in (end, f"a {end} b", f"{end}a", f"a{end}", f"{end} {end}", f"  {end}  x y", f"a {end}\n {end}{end} z", f"{end[:5]} {end[5:]}"):
        assert encoder([text])[0].tolist() == plainly.encode(text, add_special_tokens=False).ids
    assert 50256 in encoder([f"a {end} b"])[0].tolist()


def test_mixing_gains_on_real_ids():
    path = "/root/testdata/sf0.1/documents.parquet"
    texts = [t for t in pq.read_table(path, columns=["text"])["text"].to_pylist() if t]
    ids, _ = tokens.Encoder(tokens.tokenizer_path())(texts[:1000])
    n = np.bincount(ids)
    share = n[n > 0] / len(ids)
    order_0 = -(share * np.log2(share)).sum()
    packed = rangecoder.pack(ids.astype(np.int64))
    assert np.array_equal(rangecoder.unpack(packed), ids)
    assert len(packed) * 8 / len(ids) < order_0 - 0.5


def test_ids_that_do_not_fit_raise():
    for bad in (65536, -1):
        with pytest.raises(ValueError, match="ids must be"):
            rangecoder.pack(np.array([1, bad, 2]))


@SETTINGS
@given(st.lists(st.integers(0, 65535), max_size=3000))
def test_round_trip(values):
    ids = np.array(values, np.int64)
    assert np.array_equal(rangecoder.unpack(rangecoder.pack(ids)), ids)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 63, 64, 65, 4095, rangecoder.BLOCK - 1, rangecoder.BLOCK, rangecoder.BLOCK + 1, 3 * rangecoder.BLOCK + 100])
def test_round_trip_of_sizes(n):
    draw = np.random.default_rng(n)
    for ids in (draw.integers(0, 65536, n), np.minimum(draw.zipf(1.3, n), 50_000), np.full(n, 65535), np.zeros(n, np.int64)):
        assert np.array_equal(rangecoder.unpack(rangecoder.pack(ids.astype(np.int64))), ids)


def test_repetitive_ids_shrink_and_a_changed_byte_is_noticed():
    ids = np.tile(np.arange(200, 260), 1000).astype(np.int64)
    packed = rangecoder.pack(ids)
    assert len(packed) < len(ids)
    for at in (len(packed) // 2, len(packed) - 1, 9):
        broken = bytearray(packed)
        broken[at] ^= 0x55
        try:  # the last bits of a lane may not matter; other ids never come out
            assert np.array_equal(rangecoder.unpack(bytes(broken)), ids) and at == len(packed) - 1
        except ValueError:
            pass


def test_edges(spark, tmp_path):
    rows = [(3, None), (1, ""), (1, "same id"), (1, "same id"), (None, "last of all"), (-5, "<|endoftext|> é😀"), (2, "long words " * 60_000)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, shard string")
    got = sorted((tuple(r) for r in tokens.token_output(docs, path=str(tmp_path / "ids")).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [-5, 1, 1, 1, 2, 3, None]
    by = {}
    for _, _, n, crc in plain([(0, t) for _, t in rows]):
        by[n, crc] = by.get((n, crc), 0) + 1
    for _, _, n, crc in got:
        by[n, crc] -= 1
    assert not any(by.values())
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    assert tokens.token_output(docs.limit(0)).count() == 0


def test_batches_are_small_while_tokens_are_written_and_the_session_is_as_before(spark):
    def each(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    key, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.range(0, 100, 1, 1)
    before = spark.conf.get(key)
    with tokens.batches_of(spark, 30):
        assert [r.n for r in rows.mapInArrow(each, "n long").collect()] == [30, 30, 30, 10]
        with tokens.batches_of(spark, 50):
            assert spark.conf.get(key) == "30"
    assert spark.conf.get(key) == before


def test_a_waiting_worker_holds_few_words(spark, tmp_path):
    words = " ".join(f"w{n}" for n in range(40_000))
    docs = spark.createDataFrame([(1, words), (2, words)], "doc_id long, text string")
    tokens.write_tokens(docs.coalesce(1), str(tmp_path / "ids"), tokens.tokenizer_path())

    def each(batches):
        held = [len(x.known) for x in gc.get_objects() if isinstance(x, tokens.Encoder)]
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([max(held, default=0)], pa.int64())], ["n"])

    assert max(r.n for r in spark.range(0, 16, 1, 16).mapInArrow(each, "n long").collect()) <= tokens.KEPT < 40_000


def test_the_commonest_words_stay():
    encoder = tokens.Encoder(tokens.tokenizer_path())
    texts = ["x " + "often rarely " * 3 + "often " * 5 + "once"]
    before = encoder(texts)[0].tolist()
    encoder.forget(1)
    assert list(encoder.known) == ["often"] and encoder(texts)[0].tolist() == before
