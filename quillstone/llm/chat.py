"""Chat formatting by quotation linking."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import cut

QUOTED = re.compile(r"^((?:[ \t]*>)+)[ \t]?(.*)$")
#: A line that only introduces the quotation after it.
INTRODUCED = re.compile(r"(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$", re.IGNORECASE)
SIGN = 1 << 63
#: Words that a quoted part of a passage must have to be looked up inside messages.
LOOSE = 3
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def normalised(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def passage_hash(text: str) -> int | None:
    plain = normalised(text)
    return xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass"), 10) - SIGN if plain else None


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by one polynomial over the whole text: a few products each."""
    if len(words) < n or n < 1:
        return np.zeros(0, np.int64)
    ahead = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(words) - 1, BASE, np.uint64)])
    back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(words) - n, BACK, np.uint64)])
    sums = np.r_[np.uint64(0), np.add.accumulate(words * ahead)]
    return ((sums[n:] - sums[: len(sums) - n]) * back).view(np.int64)


def word_hashes(plain: str) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 10) for w in plain.split(" ") if w], np.uint64)


def parse_quotes(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """What a message says itself, and the passages it quotes with their nesting levels.

    A line's level is the number of > it begins with. A passage is a run of lines of one level;
    an empty quoted line ends it. Lines that introduce a quotation go with it.
    """
    own: list[str] = []
    passages: list[tuple[int, str]] = []
    level, held = 0, []

    def close() -> None:
        if level and any(x.strip() for x in held):
            passages.append((level, "\n".join(held)))
        held.clear()

    for line in (text or "").split("\n"):
        quoted = QUOTED.match(line)
        now, rest = (quoted[1].count(">"), quoted[2]) if quoted else (0, line)
        if now != level or (now and not rest.strip()):
            close()
        if now and not level:
            while own and not own[-1].strip():
                own.pop()
            if own and INTRODUCED.search(own[-1]):
                own.pop()
        elif now > level and passages and INTRODUCED.search(passages[-1][1].split("\n")[-1]):
            above, said = passages.pop()
            if "\n" in said:
                passages.append((above, said.rsplit("\n", 1)[0]))
        level = now
        (held if now else own).append(rest)
    close()
    return "\n".join(own).strip(), passages


def parsed(messages: DataFrame) -> DataFrame:
    """`messages` with content, said (hashes of its own passages) and quotes (rank, hash).

    A message's own passages are the whole, its paragraphs and its lines. A quoted passage is
    looked up as it stands, then by its lines; rank orders these by nesting level first. `loose`
    has the passages as runs of words, to be looked up inside messages where all this fails.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            content, said, quotes, loose = [], [], [], []
            for text in pdf["text"]:
                own, passages = parse_quotes(text)
                content.append(own)
                parts = {passage_hash(p) for p in [own, *re.split(r"\n\s*\n", own), *own.split("\n")]}
                said.append(sorted(parts - {None}))
                asked: dict[int, int] = {}
                for level, passage in passages:
                    lines = passage.split("\n")
                    for k, p in enumerate([passage, *(lines if len(lines) > 1 else [])]):
                        h = passage_hash(p)
                        if h is not None:
                            asked[h] = min(asked.get(h, 1 << 30), 2 * level + (k > 0))
                runs = [(level, word_hashes(normalised(p))) for level, p in passages]
                loose.append([{"rank": level, "n": len(w), "hash": int(run_hashes(w, len(w))[0])} for level, w in runs if len(w) >= LOOSE])
                quotes.append([{"rank": r, "hash": h} for h, r in sorted(asked.items())])
            yield pdf[["conv_id", "turn", "role"]].assign(content=content, said=said, quotes=quotes, loose=loose)

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(each, "conv_id long, turn long, role string, content string, said array<long>, quotes array<struct<rank:int,hash:long>>, loose array<struct<rank:int,n:int,hash:long>>")


def _answered(met: DataFrame) -> DataFrame:
    met = met.where(F.col("origin") < F.col("turn"))
    return met.groupBy("conv_id", "turn").agg(
        F.max_by("origin", F.struct(-F.col("rank"), "origin")).alias("reply_to"), F.count_distinct("origin").alias("quoted")
    )


def reply_links(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, reply_to, quoted): the message that each quoting message answers.

    The original of a passage is the first message of the conversation that says it. Of the
    originals that come before it, a message answers that of its least nested passage, the
    latest among equals. The first saying is a minimum, combined before the shuffle, so a phrase
    that a long conversation repeats costs one row. A message none of whose passages is a whole
    message, paragraph or line answers the first that has one of them inside.
    """
    asks = rows.where(F.size("quotes") > 0).select("conv_id", "turn", F.inline("quotes"))
    wanted = asks.select("conv_id", "hash").distinct()
    said = rows.select("conv_id", "turn", F.explode("said").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    first = said.join(wanted, ["conv_id", "hash"], "left_semi")
    links = cut(_answered(asks.join(first, ["conv_id", "hash"])))
    left = rows.where(F.size("loose") > 0).join(links, ["conv_id", "turn"], "left_anti").select("conv_id", "turn", F.inline("loose"))
    left = cut(left.where("conv_id is not null and turn is not null"))
    if left.isEmpty():
        return links
    inside = runs_inside(rows, left)
    return links.unionByName(_answered(left.join(inside, ["conv_id", "n", "hash"])))


def runs_inside(rows: DataFrame, asked: DataFrame, salts: int = 16) -> DataFrame:
    """Rows (conv_id, n, hash, origin): the first message in which each asked run of n words stands.

    Messages meet the lengths that their conversation asks for, in `salts` parts of it, and are
    hashed run by run; only runs that are asked for leave the task's stage.
    """
    lengths = asked.groupBy("conv_id").agg(F.sort_array(F.collect_set("n")).alias("ns"))
    lengths = lengths.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    texts = rows.select("conv_id", "turn", "content", F.pmod(F.xxhash64("turn"), F.lit(salts)).cast("int").alias("_salt"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for conv, turn, content, ns in zip(pdf["conv_id"], pdf["turn"], pdf["content"], pdf["ns"]):
                words = word_hashes(normalised(content))
                for n in ns:
                    found = np.unique(run_hashes(words, int(n)))
                    if len(found):
                        yield pd.DataFrame({"conv_id": conv, "turn": turn, "n": int(n), "hash": found})

    runs = texts.where("turn is not null").join(lengths, ["conv_id", "_salt"]).select("conv_id", "turn", "content", "ns").mapInPandas(each, "conv_id long, turn long, n int, hash long")
    wanted = asked.select("conv_id", "n", "hash").distinct()
    return runs.groupBy("conv_id", "n", "hash").agg(F.min("turn").alias("origin")).join(wanted, ["conv_id", "n", "hash"], "left_semi")


def threads(links: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, thread, depth): where chains of `links` begin, by doubling steps."""
    now = cut(links.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("_up"), F.col("depth").alias("_more"))
        step = now.join(up, ["conv_id", "thread"], "left")
        step = cut(step.select("conv_id", "turn", F.coalesce("_up", "thread").alias("thread"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_up").isNotNull().alias("_moved")))
        if step.where("_moved").isEmpty():
            return step.drop("_moved")
        now = step.drop("_moved")


def format_chats(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, reply_to, thread, depth, quoted, content, formatted), one a message.

    content is the message without quotes; reply_to the turn it answers by quotation, or null;
    thread the turn where its chain of answers begins (its own without one), depth its length,
    quoted how many messages it quotes. Sorted by (conv_id, thread, turn), the rows are the
    reply-ordered conversations; they stay rows, so that a conversation of any length is never
    one group. A message without conv_id or turn answers nothing. Null texts count as empty;
    repeated rows each stay; quotes without an earlier original only go; an empty table gives
    an empty one. Columns other than conv_id, turn, role and text are left out.
    """
    rows = cut(parsed(messages))
    links = cut(reply_links(rows))
    if links.isEmpty():
        linked = rows.withColumns({"reply_to": F.lit(None).cast("long"), "thread": F.lit(None).cast("long"), "depth": F.lit(0).cast("long"), "quoted": F.lit(0).cast("long")})
    else:
        linked = rows.join(links.join(threads(links), ["conv_id", "turn"]), ["conv_id", "turn"], "left")
    return linked.select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("quoted", F.lit(0)).alias("quoted"), "content",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "content").alias("formatted"),
    )


def op10_chat(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
