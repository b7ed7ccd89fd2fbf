"""Secret scans over a trigram inverted index; DataFrame functions only."""

from __future__ import annotations

import re._parser as sre
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A conjunction of clauses; a clause is a disjunction of trigram sets that must all occur.
Query = list[list[frozenset[str]]]


@dataclass(frozen=True)
class Rule:
    """A pattern (the syntax that Java and Python share); a match counts if `group` has `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Further kinds that the scan reports beside the base.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)


def trigram_query(pattern: str, widest: int = 64) -> Query:
    """The trigrams, in lower case, that any match of `pattern` must contain; [] if none must.

    Literal runs are followed through groups, alternatives, small character sets and optional
    parts as sets of strings; anything else ends a run. A run whose every string has a trigram
    gives a clause.
    """
    runs: list[set[str]] = [{""}]

    def add(strings: set[str]) -> None:
        if len(runs[-1]) * len(strings) > widest:
            runs.append({""})
        runs[-1] = {a + b for a, b in product(runs[-1], strings)}

    def finite(item) -> set[str] | None:
        """The strings that an item matches, if they are few."""
        op, value = item
        if op is sre.LITERAL:
            return {chr(value).lower()}
        if op is sre.IN:
            parts = [chr(v).lower() for o, v in value if o is sre.LITERAL]
            return set(parts) if len(parts) == len(value) <= 6 else None
        if op is sre.SUBPATTERN:
            return joined(value[3])
        if op is sre.BRANCH:
            parts = [joined(b) for b in value[1]]
            return None if None in parts else set().union(*parts)
        if op is sre.MAX_REPEAT and value[:2] == (0, 1):
            inner = joined(value[2])
            return None if inner is None else inner | {""}
        return None

    def joined(items: Iterable) -> set[str] | None:
        out = {""}
        for item in items:
            part = finite(item)
            if part is None or len(out) * len(part) > widest:
                return None
            out = {a + b for a, b in product(out, part)}
        return out

    def walk(items: Iterable) -> None:
        for item in items:
            part = finite(item)
            if part is not None:
                add(part)
            elif item[0] is sre.SUBPATTERN:
                walk(item[1][3])
            else:
                runs.append({""})

    walk(sre.parse(pattern))
    grams = lambda s: frozenset(s[k : k + 3] for k in range(len(s) - 2))
    return [[grams(s) for s in sorted(run)] for run in runs if all(len(s) > 2 for s in run)]


#: Matches of a text that are placed together.
BLOCK = 256


def row_key() -> Column:
    """One long for a row; rows that share it by chance only share candidates, which are verified."""
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index (trigram, key) of lower-cased texts, for the trigrams that queries use."""
    low = docs.select(row_key().alias("key"), F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("key", F.explode(present).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows (key, kinds): the rules whose trigram query the row's postings satisfy."""
    asked = []
    for rule in rules:
        query = trigram_query(rule.pattern)
        for c, clause in enumerate(query):
            for a, grams in enumerate(clause):
                asked += [(g, rule.kind, len(query), c, a, len(grams)) for g in sorted(grams)]
    names = ["trigram", "kind", "clauses", "clause", "alt", "need"]
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, x)]) for x in asked])
    wanted = docs.sparkSession.range(1).select(F.inline(rows))
    found = postings(docs, sorted({x[0] for x in asked})).distinct()
    # the rules' own trigrams: a table that only the rule set makes larger
    met = found.join(F.broadcast(wanted), "trigram").groupBy("key", "kind", "clauses", "clause", "alt", "need").agg(F.count("*").alias("n"))
    whole = met.where("n = need").groupBy("key", "kind", "clauses").agg(F.count_distinct("clause").alias("n")).where("n = clauses")
    return whole.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def _pieces(text: Column, rule: Rule) -> Column:
    """Array of (gap, size, part): what stands before each leftmost match, the match and its group, in code points.

    The pieces between matches and the matches alternate, so their lengths add up to offsets.
    """
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x))
    whole = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
    parts = [lengths(F.split(text, rule.pattern, -1)).alias("gap"), whole.alias("size")]
    if rule.group:
        parts.append(lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))).alias("part"))
    return F.filter(F.arrays_zip(*parts), lambda x: x["size"].isNotNull())


def _blocks(pieces: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(pieces) / BLOCK).cast("int") - 1), lambda b: F.slice(pieces, b * BLOCK + 1, BLOCK))


def _starts(blocks: Column) -> Column:
    """Where each block begins, and the last one ends."""
    width = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + x["size"])
    return F.aggregate(blocks, F.array(F.lit(0)), lambda acc, block: F.concat(acc, F.array(F.element_at(acc, -1) + width(block))))


def _spans(blocks: Column, starts: Column, rule: Rule, kind: int) -> Column:
    """Spans (start, kind, end) of the matches that count."""

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + x["size"]).alias("end"))
        out = F.when(x["part" if rule.group else "size"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct((begin + x["size"]).alias("at"), out.alias("out"))

    each = lambda block, k: F.aggregate(block, F.struct(F.get(starts, k).alias("at"), _none().alias("out")), step, lambda acc: acc["out"])
    return F.flatten(F.transform(blocks, each))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """`docs` with spans: array of (start, kind, end), sorted; kind is the rule's index.

    A rule with mandatory trigrams runs only on rows that the index names; one without runs on
    every row, behind a plain test for its pattern. Matches are placed block by block: an array
    is copied to grow, so it grows within a block only, and once a block, and the time of a text
    stays in proportion to it. Null texts count as empty; repeated rows are scanned alike; an
    empty table gives an empty one. An input column `spans` is replaced; the helpers' names
    (_text, _key, _kinds, and _pieces, _blocks and _starts with a number) must be free.
    """
    docs = docs.drop("spans").withColumn("_text", F.coalesce("text", F.lit("")))
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    named = docs.withColumn("_key", row_key()).join(
        candidates(docs, indexed).select(F.col("key").alias("_key"), F.col("kinds").alias("_kinds")), "_key", "left"
    )
    text = F.col("_text")
    pieces = {}
    for k, rule in enumerate(rules):
        if rule in indexed:
            asked = F.array_contains("_kinds", rule.kind)
        else:
            most = rule.pattern.removesuffix("+") + "{%d,}" % rule.least if rule.pattern.endswith("]+") and not rule.group else rule.pattern
            asked = text.rlike(most)
        pieces[f"_pieces{k}"] = F.when(asked, _pieces(text, rule))
    # one column a step, so that no step is worked out twice
    out = named.withColumns(pieces).drop("_text", "_kinds", "_key")
    out = out.withColumns({f"_blocks{k}": F.when(F.size(f"_pieces{k}") > 0, _blocks(F.col(f"_pieces{k}"))) for k in range(len(rules))}).drop(*pieces)
    out = out.withColumns({f"_starts{k}": _starts(F.col(f"_blocks{k}")) for k in range(len(rules))})
    spans = [F.coalesce(_spans(F.col(f"_blocks{k}"), F.col(f"_starts{k}"), rule, k), _none()) for k, rule in enumerate(rules)]
    return out.withColumn("spans", F.array_sort(F.concat(*spans))).drop(*[f"_{c}{k}" for c in ("blocks", "starts") for k in range(len(rules))])


def as_text(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = BASE + MORE
    found = scan_secrets(docs, rules)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(as_text(base, rules), 256).alias("base_sha256"), as_text(F.col("spans"), rules).alias("spans"),
    )
