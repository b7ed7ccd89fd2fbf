"""License scans by diagonal voting on rolling word k-gram hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quillstone.llm.decontaminate import Words, shingles

#: Words of a text whose letters A-Z are in lower case.
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    #: Share of the template's k-grams that a span must hold; 1 is the exact phrase.
    least: float = 1.0


#: The base phrases and their labels.
BASE = (
    Template("cc-by", "cc by"),
    Template("gpl", "general public license"),
    Template("reserved", "all rights reserved"),
)
#: Well-known sentences of licenses, found in whole or in most of their words.
MORE = (
    Template("apache-2.0", "licensed under the apache license version 2 0", 0.6),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 0.6),
    Template("mit", "released under the mit license", 0.6),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 0.6),
    Template("gpl", "under the terms of the gnu general public license as published by the free software foundation", 0.6),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.6),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("public-domain", "released into the public domain", 0.6),
)


def words_of(text: str | None) -> list[str]:
    """Words of a text with A-Z, and no other letters, in lower case."""
    return WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def hashed(words: list[str], book: Words) -> np.ndarray:
    return np.fromiter(map(book.__getitem__, words), np.uint64, len(words))


def template_grams(spark: SparkSession, templates: tuple[Template, ...], k: int) -> DataFrame:
    """Rows (h, template, tpos, size, least, label, said): as many as the library has words."""
    rows, book = [], Words()
    for t, x in enumerate(templates):
        words = x.words.split(" ")
        for at, h in enumerate(shingles(hashed(words, book), k).view(np.int64).tolist()):
            rows.append((h, t, at, len(words), float(x.least), x.label, " ".join(words[at : at + k]) + " "))
    return spark.createDataFrame(rows, "h long, template int, tpos int, size int, least double, label string, said string")


def rolling_grams(docs: DataFrame, k: int, piece: int = 1_000_000) -> DataFrame:
    """Rows (doc_id, key, line, starts, grams): a text's words as UTF-8 with a blank after each, the
    byte at which each begins, and the hash of the k words from each on. Texts of fewer words
    are left out.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = Words(100_000)
        for pdf in batches:
            size = np.cumsum([len(t or "") for t in pdf["text"]])
            for _, part in pdf.groupby(size // piece):
                out = []
                for doc, key, text in zip(part["doc_id"].astype(object), part["key"], part["text"]):
                    words = words_of(text)
                    if len(words) >= k:
                        line = (" ".join(words) + " ").encode("utf-8", "surrogatepass")
                        ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32) + 1
                        starts = np.concatenate([[0], ends[:-1]]).astype(np.int32)
                        out.append((None if pd.isna(doc) else int(doc), key, line, starts, shingles(hashed(words, book), k).view(np.int64)))
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "key", "line", "starts", "grams"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text")
    return rows.mapInPandas(each, "doc_id long, key long, line binary, starts array<int>, grams array<long>")


@F.pandas_udf(LongType())
def word_count(text: pd.Series) -> pd.Series:
    return pd.Series([len(words_of(t)) for t in text], dtype="int64")


def license_spans(docs: DataFrame, templates: tuple[Template, ...] = BASE + MORE, k: int = 2) -> DataFrame:
    """Rows (doc_id, key, template, label, start, n_words, share): verified spans.

    Every k-gram of every text is joined to the template positions that have its hash; hits of
    one (row, template, offset) vote for that diagonal. Diagonals of one template that lie next
    to each other, as a word put in or left out makes them, count as one span; its share of the
    template's k-grams, compared word by word, must reach the template's. The library is a
    parameter of fixed size, so its side of the join is sent to every task.
    Rows alike in doc_id and text have one set of spans. Null texts count as empty; an empty
    table gives no spans. Columns other than doc_id and text are not read. Of diagonals in one
    cell with as many votes, the last leads.
    """
    rolled = rolling_grams(docs, k).select("doc_id", "key", "line", "starts", F.posexplode("grams").alias("pos", "h"))
    hits = rolled.join(F.broadcast(template_grams(docs.sparkSession, templates, k)), "h")
    # the words decide, not their hash; bytes are cut out where they stand, however long the text
    said = F.col("said").cast("binary")
    hits = hits.where(F.col("line").substr(F.get("starts", "pos") + 1, F.length(said)) == said)
    votes = hits.groupBy("doc_id", "key", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("tpos"), F.first("size").alias("size"), F.first("least").alias("least"), F.first("label").alias("label")
    )
    # a phrase wanted whole needs one full diagonal
    total = F.col("size") - (k - 1)
    exact = votes.where((F.col("least") >= 1) & (F.size("tpos") == total)).select(
        "doc_id", "key", "template", "label", F.col("diagonal").alias("start"), F.col("size").alias("n_words"), F.lit(1.0).alias("share")
    )
    # else diagonals meet in cells of the template's length, each also in the next cell, so that
    # near ones share one; a cell holds as many diagonals as the template has words
    part = votes.where(F.col("least") < 1).withColumn("width", F.greatest(F.col("size"), F.lit(4)))
    cell = F.floor(F.col("diagonal") / F.col("width"))
    near = part.withColumn("cell", F.explode(F.array(cell, cell + 1))).groupBy("doc_id", "key", "template", "cell", "size", "least", "label").agg(
        F.array_sort(F.collect_list(F.struct(F.size("tpos").alias("n"), "diagonal", "tpos"))).alias("all")
    )
    best = F.element_at("all", -1)
    drift = F.filter("all", lambda x: F.abs(x["diagonal"] - best["diagonal"]) <= 2)
    merged = near.withColumns({
        "lead": best["diagonal"],
        "tpos": F.array_distinct(F.flatten(F.transform(drift, lambda x: x["tpos"]))),
    }).withColumn("share", F.size("tpos") / (F.col("size") - (k - 1)))
    spans = merged.where(F.col("share") >= F.col("least")).select(
        "doc_id", "key", "template", "label",
        F.greatest(F.col("lead") + F.array_min("tpos"), F.lit(0)).alias("start"),
        (F.array_max("tpos") - F.array_min("tpos") + k).alias("n_words"), "share",
    ).distinct()
    return exact.unionByName(spans)


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = license_spans(docs)
    base = F.col("template") < len(BASE)
    per = spans.groupBy("key").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    words = docs.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("key"), word_count("text").alias("n_words")
    )
    return words.join(per, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
