"""Hash-derived splits, seeds and rank keys; JVM-side only."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed(*parts: Column | str | int, sep: str = ":") -> Column:
    """sha256, in hex, of the joined parts."""
    return F.sha2(F.concat_ws(sep, *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def unsigned(hexed: Column, digits: int) -> Column:
    """The first hex digits of a digest as an unsigned number."""
    return F.conv(F.substring(hexed, 1, digits), 16, 10).cast("decimal(20,0)")


def hash_unit(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the first eight bytes of the digest."""
    return unsigned(keyed(*parts), 16).cast("double") / F.lit(18446744073709551616.0)


def hash_split(seed: int, source: Column, test: float, val: float) -> Column:
    u = hash_unit(seed, source, "split")
    return F.when(u < test, "test").when(u < test + val, "val").otherwise("train")


def scenario_seed(seed: int, source: Column, scenario: Column) -> Column:
    return unsigned(keyed(seed, source, scenario), 8).cast("long")


def candidate_seed(seed: int, epoch: Column, visit: Column, sample: Column, candidate: Column) -> Column:
    """63 bits from the first eight bytes."""
    return F.pmod(unsigned(keyed(seed, epoch, visit, sample, candidate), 16), F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def canonical_sha(value) -> str:
    """sha256 of a small driver-side object as JSON: sorted keys, no blanks, no NaN."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def tree_sha(files: DataFrame) -> DataFrame:
    """One digest over `files(name, sha256)`: that of the lines name, tab, sha256 in name order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("name", "sha256"))), lambda x: F.concat(x["name"], F.lit("\t"), x["sha256"], F.lit("\n")))
    return files.agg(F.sha2(F.array_join(lines, ""), 256).alias("tree_sha256"))


def prefix_sha(records: DataFrame, order: str, fields: list[str], n: int) -> DataFrame:
    """One digest over the first n records in `order`: lines of the key and the fields, tabs between, arrays comma-joined."""
    kinds = dict(records.dtypes)
    part = lambda c: F.array_join(c, ",") if kinds[c].startswith("array") else F.col(c).cast("string")
    line = F.concat(F.concat_ws("\t", F.col(order).cast("string"), *[part(c) for c in fields]), F.lit("\n"))
    first = records.select(F.col(order).alias("_o"), line.alias("_line")).orderBy("_o").limit(n)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_line"))), lambda x: x["_line"])
    return first.agg(F.sha2(F.array_join(lines, ""), 256).alias("prefix_sha"))
