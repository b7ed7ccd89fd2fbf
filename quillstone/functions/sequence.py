"""Edit distance, alignment, repetition and the row scores built on them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quillstone.functions.text import is_blank, normalize

# The band of a reference in which audio is dropped, both ends included.
GAP_LOW, GAP_HIGH = 0.40, 0.55
OPS = ("match", "substitute", "delete", "insert")


def _columns(ref: Sequence, hyp: Sequence) -> list[tuple[int, int, int, int]]:
    """For each column of the distance table the bits of its steps: down by +1, down by -1, across by +1, across by -1.

    Bit i - 1 is row i's. A column follows from the one before by a dozen operations on whole
    numbers of as many bits as the reference has tokens, instead of one cell at a time.
    """
    mask = (1 << len(ref)) - 1
    where: dict = {}
    for i, t in enumerate(ref):
        where[t] = where.get(t, 0) | 1 << i
    up, down = mask, 0
    out = [(up, down, 0, 0)]
    for t in hyp:
        same = where.get(t, 0)
        level = (((same & up) + up) ^ up) | same | down
        right, left = down | (mask & ~(level | up)), level & up
        over = (right << 1) | 1  # the first row rises by one in each column
        up, down = mask & ((left << 1) | ~(level | over)), mask & level & over
        out.append((up, down, right & mask, left & mask))
    return out


def edit_distance(ref: Sequence, hyp: Sequence) -> int:
    """Unit-cost edit distance."""
    last = len(ref) - 1
    if last < 0:
        return len(hyp)
    return len(ref) + sum((c[2] >> last & 1) - (c[3] >> last & 1) for c in _columns(ref, hyp)[1:])


def align(ref: Sequence, hyp: Sequence) -> list[tuple[str, int, int]]:
    """Operations (op, ref_index, hyp_index) of a least-cost alignment, in order.

    Read from the end; of equally good steps: match, then substitute, delete, insert. An
    insertion has the index of the reference token still ahead, a deletion that of the
    hypothesis.
    """
    codes, refs, hyps = aligned(ref, hyp)
    return [(OPS[c], i, j) for c, i, j in zip(codes, refs, hyps)]


def aligned(ref: Sequence, hyp: Sequence) -> tuple[list[int], list[int], list[int]]:
    """The operations of `align` as three lists: number of the operation, ref_index, hyp_index."""
    columns = _columns(ref, hyp)
    i, j = len(ref), len(hyp)
    codes, refs, hyps = [], [], []
    while i or j:
        if i and j:
            up, _, right, left = columns[j]
            before = columns[j - 1]
            at = i - 1
            # what the diagonal step adds: across in this row, then down in the column before
            step = (right >> at & 1) - (left >> at & 1) + (before[0] >> at & 1) - (before[1] >> at & 1)
            if ref[at] == hyp[j - 1] and step == 0:
                code = 0
            elif step == 1:
                code = 1
            else:
                code = 2 if up >> at & 1 else 3
        else:
            code = 2 if i else 3
        i, j = i - (code != 3), j - (code != 2)
        codes.append(code)
        refs.append(i)
        hyps.append(j)
    return codes[::-1], refs[::-1], hyps[::-1]


def in_gap(index: int, length: int) -> bool:
    return GAP_LOW <= index / length <= GAP_HIGH


OP = StructType([StructField("op", StringType()), StructField("ref_index", IntegerType()), StructField("hyp_index", IntegerType())])
BOTH = StructType([StructField("chosen", StringType()), StructField("rejected", StringType())])


@arrow_udf(ArrayType(OP))
def align_chars(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Alignment operations of two texts by code point; null if either is null. Equal pairs of a batch are aligned once."""
    known: dict = {}
    picked: list[int | None] = []
    for a, b in zip(ref.to_pylist(), hyp.to_pylist()):
        picked.append(None if a is None or b is None else known.setdefault((a, b), len(known)))
    found = [tuple(np.array(x, np.int32) for x in aligned(a, b)) for a, b in known]
    flat = [np.concatenate([found[k][c] for k in picked if k is not None] or [np.zeros(0, np.int32)]) for c in range(3)]
    ends = np.cumsum([0, *[0 if k is None else len(found[k][0]) for k in picked]])
    names = pa.DictionaryArray.from_arrays(pa.array(flat[0]), pa.array(OPS)).cast(pa.string())
    ops = pa.StructArray.from_arrays([names, pa.array(flat[1]), pa.array(flat[2])], [f.name for f in OP])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ops, mask=pa.array([k is None for k in picked]))


@pandas_udf(IntegerType())
def token_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Edit distance of two token arrays."""
    return pd.Series([None if a is None or b is None else edit_distance(list(a), list(b)) for a, b in zip(ref, hyp)], dtype="Int32")


def gap_insertions(ops: Column, ref_length: Column) -> Column:
    """Insertions anchored in the gap band of the reference; an empty reference raises."""
    where = F.size(F.filter(ops, lambda o: (o["op"] == "insert") & (o["ref_index"] / ref_length).between(GAP_LOW, GAP_HIGH)))
    return F.when(ref_length > 0, where).otherwise(F.raise_error(F.lit("empty reference")).cast("int"))


@pandas_udf(BOTH)
def strip_gap(chosen: pd.Series, rejected: pd.Series) -> pd.DataFrame:
    """Both texts without what their alignment places in the gap band of the chosen one."""
    out = []
    for a, b in zip(chosen, rejected):
        if not a or b is None:
            out.append((a, b))
            continue
        keep = [(o, i, j) for o, i, j in align(a, b) if not in_gap(i, len(a))]
        out.append(("".join(a[i] for o, i, _ in keep if o != "insert"), "".join(b[j] for o, _, j in keep if o != "delete")))
    return pd.DataFrame(out, columns=["chosen", "rejected"])


def is_repeated(text: Column) -> Column:
    """A character four times in a row, or a block of 2 to 8 three times in a row."""
    return text.rlike(r"(?s)(.)\1{3}") | text.rlike(r"(?s)(.{2,8})\1\1")


def is_long(ref_length: Column, hyp_length: Column) -> Column:
    return (ref_length > 0) & (hyp_length > 1.5 * ref_length)


def hamming(a: Column, b: Column) -> Column:
    """Positions at which two texts of equal length differ; null if their lengths differ."""
    differ = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda x: x))
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) == 0, 0).otherwise(differ))


def mismatch_mask(a: Column, b: Column) -> Column:
    """Where two label arrays differ, or all true if nowhere; empty or unequal arrays raise."""
    mask = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    mask = F.when(F.exists(mask, lambda x: x), mask).otherwise(F.transform(a, lambda x: F.lit(True)))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), mask).otherwise(F.raise_error(F.lit("empty or unequal labels")).cast("array<boolean>"))


def label_mask(ids: Column, prefix: Column, padding: Column, ignore: int = -100) -> Column:
    """Ids with the prompt's prefix and the padding masked."""
    return F.transform(ids, lambda x, i: F.when((i < prefix) | (F.get(padding, i) == 0), F.lit(ignore)).otherwise(x))


def shifted_labels(labels: Column, ignore: int = -100) -> Column:
    """What a causal model is trained on: labels from the second on that aren't masked."""
    return F.filter(F.slice(labels, 2, 2147483646), lambda x: x != ignore)


def scored(ref: Column, pred: Column, error: Column, stop: Column, norm=normalize) -> dict[str, Column]:
    """The score fields of a row.

    A row with an error is scored against the empty text, while its normalised prediction and
    flags come from the real one. A reference that normalises to nothing raises.
    """
    failed = ~is_blank(error)
    r, p = norm(ref), norm(F.coalesce(pred, F.lit("")))
    judged = F.when(failed, F.lit("")).otherwise(p)
    edits = F.when(F.length(r) > 0, F.levenshtein(r, judged)).otherwise(F.raise_error(F.lit("empty reference after normalisation")).cast("int"))
    return {
        "normalization_version": F.lit("zh-cer-v1"),
        "reference_normalized": r,
        "prediction_normalized": p,
        "scored_prediction_normalized": judged,
        "edit_count": edits.cast("long"),
        "reference_char_count": F.length(r).cast("long"),
        "sample_cer": edits / F.length(r),
        "empty_output": p == "",
        "repeated_output": is_repeated(p),
        "long_output": is_long(F.length(r), F.length(p)),
        "truncated": F.coalesce(stop == "length", F.lit(False)),
        "inference_error": failed,
        "valid_output": ~failed & (p != ""),
    }


def word_scored(ref_words: Column, pred_words: Column, failed: Column) -> dict[str, Column]:
    """Word-level score fields; no reference words raise, a failed row has no predicted ones."""
    judged = F.when(failed, F.array().cast("array<string>")).otherwise(pred_words)
    edits = F.when(F.size(ref_words) > 0, token_distance(ref_words, judged)).otherwise(F.raise_error(F.lit("no reference words")).cast("int"))
    return {
        "word_edit_count": edits.cast("long"),
        "reference_word_count": F.size(ref_words).cast("long"),
        "sample_wer": edits / F.size(ref_words),
    }
