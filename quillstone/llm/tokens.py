"""Token ids of whole texts, written as range-coded blocks and read back."""

from __future__ import annotations

import contextlib
import functools
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import wording
from quillstone.llm.common import lean, release, running_total, scratch
from quillstone.llm.wording import spread

#: A single blank or line feed between two characters that aren't white space always begins a piece of the
#: byte-level pre-tokenizer, so the parts between such places are encoded on their own.
BORDER = r"(?<=\S)(?=[ \n]\S)"
#: ASCII white space by its byte; other white space as numbers of its bytes.
WHITE = np.array([n < 128 and chr(n).isspace() for n in range(256)])
WIDE_WHITE = [int.from_bytes(chr(n).encode()) for n in range(0x80, 0x3001) if chr(n).isspace()]
#: Ids of a frame, about.
FRAME = 1 << 22
#: Bytes of text that are cut at once.
TOGETHER = 1 << 21
#: Parts that a worker remembers between tasks.
KEPT = 1 << 14
#: Rows of a batch that Spark hands to a task's worker: it holds one whole, and so does the executor.
ROWS = 1000
#: A frame's row.
FRAMES = pa.schema(
    [("shard", pa.int32()), ("frame", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("payload", pa.binary())]
)


def border(tokenizer) -> re.Pattern:
    """Where texts may be cut: at such places, but not inside an added token, which is one id."""
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    inside = [t[:k] for t in added for k in range(1, len(t)) if t[k] in " \n"]
    if any(t[0].isspace() or t[-1].isspace() for t in added if t):
        inside.append("")  # such a token may begin or end at a border: texts stay whole
    return re.compile(BORDER + "".join(f"(?<!{re.escape(p)})" for p in inside))


@functools.cache
def loaded(path: str):
    """The tokenizer, read once a worker; it runs on the task's own thread, as the cores are Spark's."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Unsplit:
    """Ids of parts by the file's own merges on many parts at once, without its search for pieces.

    That gives the pieces' ids where no token joins what a piece's border parts, and no piece ends inside a run
    of letters, digits or marks; parts where the tokens or the tokenizer leave that open are told by `doubtful`.
    """

    #: Bytes of parts that are merged in one go.
    AT_ONCE = 4096

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer

        self.pieces = tokenizer.pre_tokenizer.pre_tokenize_str
        self.merges = Tokenizer(tokenizer.model)
        self.shown = np.zeros(256, "<u2")  # the byte-level alphabet, as the tokenizer shows it
        for c in (*map(chr, range(0x800)), *(chr(max(0x800, n << 12)) for n in range(16)), *(chr(max(0x10000, n << 18)) for n in range(5))):
            for byte, mark in zip(c.encode(), "".join(p for p, _ in self.pieces(c))):
                self.shown[byte] = ord(mark)
        kinds = {chr(self.shown[b]): "L" if chr(b).isalpha() else "N" if chr(b).isdigit() else "S" if b == 0x20 else "W" if chr(b).isspace() else "P" for b in range(128)}
        pairs = {x for t in tokenizer.get_vocab(with_added_tokens=False) for x in zip(t, t[1:])}
        pairs = {(x, y) for x, y in pairs if kinds.get(x, "H") != kinds.get(y, "H")}
        byte = {chr(c): n for n, c in enumerate(self.shown.tolist())}
        #: Pairs of bytes, as 256 * first + second, that leave open whether a piece's border lies there.
        self.open = np.zeros(1 << 16, bool)
        for x, y in pairs:
            if x in byte and y in byte and kinds.get(x) != "S" and {kinds.get(x, "H"), kinds.get(y, "H")} != {"H", "L"}:
                self.open[byte[x] << 8 | byte[y]] = True
        white = np.flatnonzero(WHITE)
        self.open[(white[:, None] << 8 | white).reshape(-1)] = True
        self.open[[ord("'") << 8 | n for n in range(256) if n > 127 or chr(n).isalpha()]] = True
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content]
        self.letters: dict[str, bool] = {}
        model = tokenizer.model
        plain = type(model).__name__ == "BPE" and not (model.dropout or model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix)
        #: Whether no token has a blank behind ASCII but blanks, so that parts never join there.
        self.apart = plain and not any(kinds.get(y, "H") == "S" and x in kinds for x, y in pairs)

    def _letter(self, c: str) -> bool:
        """Whether the tokenizer keeps a character with the letters beside it."""
        if c not in self.letters:
            word = f"a{c}a{c}{c}a"
            self.letters[c] = [p for p, _ in self.pieces(word)] == ["".join(map(chr, self.shown[[*word.encode()]]))]
        return self.letters[c]

    def doubtful(self, parts: list[str], whole: str, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which parts must be left to the tokenizer; `whole` and its bytes hold them in a row, `ends` tells where in the bytes."""
        out = np.zeros(len(parts), bool)
        pairs = data[:-1].astype(np.uint16) << 8 | data[1:]
        out[np.searchsorted(ends, np.flatnonzero(self.open.take(pairs)), side="right")] = True
        others = [c for c in (() if whole.isascii() else set(whole)) if c > "\x7f" and not self._letter(c)]
        others = [re.escape(x) for x in (*others, *(t for t in self.added if t in whole))]
        if others:
            chars = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
            out[np.searchsorted(chars, [m.start() for m in re.finditer("|".join(others), whole)], side="right")] = True
        return out

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ids of parts whose bytes are in a row, given where they end."""
        marks = self.shown[data].tobytes()
        cuts = ends[np.unique(np.searchsorted(ends, np.arange(self.AT_ONCE, ends[-1] + self.AT_ONCE, self.AT_ONCE)).clip(max=len(ends) - 1))].tolist()
        texts = (marks[2 * i : 2 * j].decode("utf-16-le") for i, j in zip([0, *cuts], cuts))
        coded = []
        while some := [*islice(texts, 16)]:  # the library keeps over 100 bytes an id until a call's ids are fetched
            coded += [np.array(e.ids, np.int32) for e in self.merges.encode_batch_fast(some, add_special_tokens=False)]
        return np.concatenate(coded)


@functools.cache
def unsplit(path: str) -> Unsplit:
    return Unsplit(loaded(path))


def widths(tokenizer) -> np.ndarray | None:
    """How many bytes of text each id stands for; None if the file's tokens don't tell."""
    if tokenizer.normalizer is not None or type(tokenizer.pre_tokenizer).__name__ != "ByteLevel" or tokenizer.pre_tokenizer.add_prefix_space:
        return None
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, n in vocabulary.items():
        out[n] = len(token)  # a byte is one character there
    for n, added in tokenizer.get_added_tokens_decoder().items():
        out[n] = len(added.content.encode())
    return out


@functools.cache
def facts(path: str) -> tuple[re.Pattern, np.ndarray | None]:
    """A file's borders, and the bytes of its ids, if texts are cut at all borders."""
    at = border(loaded(path))
    return at, widths(loaded(path)) if at.pattern == BORDER else None


class Encoder:
    """Ids of texts by a tokenizers file; each distinct part is encoded once and remembered.

    About `most` parts are remembered; beyond that those go that came once only, or all, if that isn't enough.
    A part's key is itself without its first blank; that of a text's first part is a blank and the part, unless a
    line feed begins the part.
    """

    #: From how many new parts on they are merged without a search for pieces.
    MANY = 1000

    def __init__(self, path: str, most: int = 500_000):
        self.path, self.tokenizer = path, loaded(path)
        self.border, self.bytes = facts(path)
        self.plain = self.border.pattern == BORDER
        self.most = most
        self._keep([], np.zeros(0, np.int64))

    def _keep(self, keys: list[str], at: np.ndarray) -> None:
        """Remember the parts numbered `at` alone, whose keys are given."""
        if len(keys):
            size = self.size[at]
            self.flat, self.start, self.size = spread(self.flat, self.start, self.size, at), np.cumsum(size) - size, size
        else:
            self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known, self.uses = dict(zip(keys, range(len(keys)))), np.zeros(len(keys), np.int64)

    @property
    def full(self) -> bool:
        return len(self.known) > self.most

    def forget(self, most: int | None = None) -> None:
        """Forget parts, with `most` all but the commonest so many; their numbers are dealt anew."""
        often = np.flatnonzero(self.uses > 1)
        if most is not None and len(often) > most:
            often = np.sort(often[np.argpartition(self.uses[often], -most)[-most:]])
        elif len(often) > self.most // 2:
            often = often[:0]
        keys = list(self.known) if len(often) else []
        # new strings side by side: a few old ones here and there would keep the memory of all
        kept = pa.array([keys[n] for n in often], pa.large_string())
        del keys
        self.known = {}
        self._keep(kept.to_pylist(), often)

    def _one_by_one(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.int32, int(size.sum())), size

    def _in_a_row(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts that begin at a border and end before one."""
        if len(parts) < self.MANY or not unsplit(self.path).apart:
            return self._together(parts)
        whole = "".join(parts)
        doubt = unsplit(self.path).doubtful(parts, whole, np.frombuffer(whole.encode(), np.uint8), self._ends(parts))
        return self._both(parts, ((~doubt, self._merged), (doubt, self._together)))

    def _merged(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ends = self._ends(parts)
        return self._cut(unsplit(self.path)(np.frombuffer("".join(parts).encode(), np.uint8), ends), parts, ends)

    def _together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """In one call: they make a text with borders between them."""
        ids = self.tokenizer.encode_batch_fast(["".join(parts)], add_special_tokens=False)[0].ids
        return self._cut(np.array(ids, np.int32), parts, self._ends(parts))

    def _ends(self, parts: list[str]) -> np.ndarray:
        """Where parts in a row end, in bytes."""
        return np.cumsum(pc.binary_length(pa.array(parts, pa.large_string())).to_numpy())

    def _cut(self, ids: np.ndarray, parts: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts in a row, and how many each part has."""
        reach = np.cumsum(self.bytes[ids])
        last = np.searchsorted(reach, ends)
        if len(reach) != last[-1] + 1 or not np.array_equal(reach[last], ends):
            return self._one_by_one(parts)
        return ids, np.diff(last + 1, prepend=0)

    def _both(self, parts: list[str], ways) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of parts, of which each way takes its own."""
        size, coded = np.zeros(len(parts), np.int64), []
        for those, way in ways:
            if those.any():
                ids, size[those] = way([parts[n] for n in np.flatnonzero(those)])
                coded.append((ids, those))
        start, at = np.zeros(len(parts), np.int64), 0
        for ids, those in coded:
            start[those] = at + np.cumsum(size[those]) - size[those]
            at += len(ids)
        return spread(np.concatenate([ids for ids, _ in coded]), start, size, np.arange(len(parts))), size

    def _add(self, keys: list[str]) -> None:
        parts = [k[1:] if k[0] == " " else k if k[0] == "\n" else " " + k for k in keys]
        # a text's first part has no border before it, and its last may end in white space
        alone = np.fromiter((self.bytes is None or k[0] == " " or k[-1].isspace() for k in keys), bool, len(keys))
        ids, size = self._both(parts, ((alone, self._one_by_one), (~alone, self._in_a_row)))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.flat, self.size = np.concatenate([self.flat, ids]), np.concatenate([self.size, size])

    def cut(self, texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
        """All texts' parts in a row, and how many each text has."""
        begin = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        lo, hi = int(begin[0]), int(begin[-1])
        if lo == hi:
            return texts.slice(0, 0), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        full = np.flatnonzero(np.diff(begin))
        starts = begin[full]
        if self.plain:
            bytes_ = data[lo:hi]
            at = np.flatnonzero((bytes_ == 0x20) | (bytes_ == 0x0A)) + lo
            before, after = data[np.maximum(at - 1, lo)], data[np.minimum(at + 1, hi - 1)]
            none = WHITE[before] | WHITE[after]
            for beside, places in ((before, (-2, -3)), (after, (1, 1))):
                some = np.flatnonzero(beside > 127)
                for place, k in zip(places, (2, 3)):
                    code = np.zeros(len(some), np.int64)
                    for d in range(k):
                        code = code << 8 | data[np.clip(at[some] + place + d, lo, hi - 1)]
                    none[some] |= np.isin(code, WIDE_WHITE)
            edges = np.concatenate([starts, begin[full + 1] - 1])
            none |= np.isin(at, edges[WHITE[data[edges]]])
            at = at[~none]
        else:
            at = np.concatenate([begin[n] + np.cumsum([len(p.encode()) for p in self.border.split(texts[n].as_py())])[:-1] for n in full.tolist()])
        cuts = np.sort(np.concatenate([starts, at]), kind="stable")
        n = np.diff(np.searchsorted(cuts, begin))
        parts = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(np.r_[cuts, hi]), texts.buffers()[2])
        return parts, n

    def parts(self, texts: list[str] | pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts' parts in a row, and how many each text has."""
        each, n = self.cut(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        coded = each.dictionary_encode()
        before, distinct = len(self.known), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        keys = [(p[1:] if p[0] == " " else p) if p[0] in " \n" and p[1:] and not p[1].isspace() else " " + p for p in distinct]
        number = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int32, len(keys))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = before + np.arange(len(new))
            fresh = [keys[n] for n in new.tolist()]
            self.known.update(zip(fresh, range(before, before + len(new))))
            self._add(fresh)
        at = number[coded.indices.to_numpy()] if len(each) else np.zeros(0, np.int32)
        uses = np.bincount(at, minlength=len(self.known))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        return at, n

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        if self.full:
            self.forget()
        at, n = self.parts(texts)
        return spread(self.flat, self.start, self.size, at), sums(self.size[at], n)


@functools.cache
def memory(path: str) -> Encoder:
    """The encoder of a worker's tasks, one after the other: what one has met again and again, the next need not encode anew."""
    return Encoder(path)


def sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sums of runs of n[0], n[1], ... values."""
    return np.diff(np.cumsum(np.r_[0, values])[np.cumsum(np.r_[0, n])])


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs begun inside send at most so many rows at once to Arrow functions."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, frame: int = FRAME) -> None:
    """Write the ids of `docs(doc_id, text)` to `path` in ascending doc_id order (null last).

    Rows are dealt by range of doc_id, equal ids by a hash of the text and then of the row's place.
    A shard (one task's rows) is written as frames: about `frame` ids of whole documents, by the parts
    that they repeat and range coded in blocks, with the documents' ids and sizes. A frame is one row of a Parquet
    dataset, which Spark commits task by task, so a lost executor costs its own shard only.
    Null texts count as empty and have the end id alone.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "_salt"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("_salt"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = memory(tokenizer)
        shard = TaskContext.get().partitionId()
        ats: list[np.ndarray] = []
        docs_in: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        held = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, number
            at = np.concatenate(ats)
            ats.clear()
            release()  # what cutting and encoding left, before a frame's tables are laid beside it
            payload = wording.pack(at, encoder.flat, encoder.start, encoder.size, end_id)
            row = [[shard], [number], [pa.concat_arrays(docs_in)], [np.concatenate(sizes)], [held], [payload]]
            docs_in.clear(), sizes.clear()
            held, number = 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, FRAMES.types)], schema=FRAMES)

        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, side="right")))
                if encoder.full:  # a frame's parts have the numbers of one memory
                    if docs_in:
                        yield flush()
                    encoder.forget()
                got, n = encoder.parts(texts.slice(at, to - at))
                size = sums(encoder.size[got], n) + 1
                ats.append(np.insert(got, np.cumsum(n), -1))
                docs_in.append(batch.column("doc_id").slice(at, to - at))
                sizes.append(size)
                held += int(size.sum())
                if held >= frame:
                    yield flush()
                at = to
        if docs_in:
            yield flush()
        encoder.forget(KEPT)  # a waiting worker holds the commonest parts, and no others

    schema = "shard int, frame int, doc_ids array<long>, sizes array<long>, n_ids long, payload binary"
    with batches_of(docs.sparkSession, ROWS):
        rows.mapInArrow(lean(each), schema).write.mode("errorifexists").option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of the files that `write_tokens` wrote.

    Frames are decoded on their own, each block against its checksum; what stands before a frame
    comes from the frames' sizes, summed by ranges.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, number, payload = (batch.column(c)[k].as_py() for c in ("shard", "frame", "payload"))
                keys, sizes = batch.column("doc_ids")[k].values, batch.column("sizes")[k].values.to_numpy()
                ids = memoryview(wording.unpack(payload))
                ends = np.cumsum(sizes)
                begins = ends - sizes
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                columns = [np.full(len(keys), shard, np.int32), np.full(len(keys), number, np.int32), keys, begins, sizes, np.array(crcs, np.int64)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["shard", "frame", "doc_id", "at", "n_tokens", "ids_crc32"])

    frames = spark.read.parquet(path)
    places = running_total(frames.select("shard", "frame", "n_ids"), [F.col("shard"), F.col("frame")], {"ids": F.col("n_ids")})
    got = frames.select("shard", "frame", "doc_ids", "sizes", "payload").mapInArrow(lean(each), "shard int, frame int, doc_id long, at long, n_tokens long, ids_crc32 long")
    placed = got.join(places.select("shard", "frame", "before_ids"), ["shard", "frame"])
    return placed.select("doc_id", (F.col("before_ids") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_output(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write `docs` as token ids to `path` (else a new folder under the shared one) and read them back.

    One row for each row of `docs`; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer or tokenizer_path())
    return read_tokens(spark, path)


def op5_tokens(spark, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
