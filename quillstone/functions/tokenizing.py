"""Token counts by a tokenizer file, locked by digest."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructType

from quillstone.functions.segment import LockError


#: Texts encoded in one call.
TOGETHER = 32


@lru_cache(maxsize=4)
def _loaded(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


def tokenizer_record(path: str, end: str) -> dict[str, object]:
    """What a count is pinned to: the file's digest, and the end token with its id; raises LockError if the file has no such token."""
    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    number = _loaded(path).token_to_id(end)
    if number is None:
        raise LockError(f"no token {end}")
    return {"mode": "encode-plus-end", "end": end, "end_id": number, "path": path, "sha256": digest}


def token_counts(rows: DataFrame, text: str, name: str, path: str, end: str, sha256: str | None = None) -> DataFrame:
    """`rows` with the tokens of the whole `text` and one end token as long `name`; a null text has null, an empty one 1.

    The file lies at `path` on every executor. Raises LockError if its digest is not `sha256`, or it lacks the end token.
    """
    record = tokenizer_record(path, end)
    if sha256 not in (None, record["sha256"]):
        raise LockError(f"digest {record['sha256']}, not {sha256}")
    rows = rows.drop(name)
    schema = StructType(list(rows.schema.fields)).add(name, LongType())

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _loaded(path)
        for pdf in batches:
            n: list[int | None] = []
            for at in range(0, len(pdf), TOGETHER):
                texts = pdf[text].iloc[at : at + TOGETHER].tolist()
                coded = iter(tokenizer.encode_batch_fast([t for t in texts if isinstance(t, str)], add_special_tokens=False))  # no offsets
                n += [1 + len(next(coded)) if isinstance(t, str) else None for t in texts]
            yield pdf.assign(**{name: pd.array(n, dtype="Int64")})

    return rows.mapInPandas(each, schema)
