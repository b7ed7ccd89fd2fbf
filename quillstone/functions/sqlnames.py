"""Functions and table functions under names for SQL text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quillstone.functions import sequence, text
from quillstone.sources.textgrid import intervals_of


@udtf(returnType="tier int, tier_name string, idx int, xmin double, xmax double, label string, problem string")
class ParseTextGrid:
    """The intervals of one TextGrid, given as text or bytes; a malformed one is one row with a problem, null gives no row."""

    def eval(self, content) -> Iterator[tuple]:
        if content is None:
            return
        try:
            found = intervals_of(content.encode() if isinstance(content, str) else bytes(content))
        except ValueError as e:
            yield None, None, None, None, None, None, str(e)
            return
        for row in found:
            yield (*row, None)


@udtf(returnType="op string, ref_index int, hyp_index int, ref_char string, hyp_char string")
class EditSteps:
    """The steps of an alignment of two texts, one a row, with the characters they concern; a null text gives no row."""

    def eval(self, ref: str, hyp: str) -> Iterator[tuple]:
        if ref is None or hyp is None:
            return
        for op, i, j in sequence.align(ref, hyp):
            yield op, i, j, ref[i] if op != "insert" else None, hyp[j] if op != "delete" else None


FUNCTIONS = {
    "zh_cer_norm": text.normalize,
    "token_levenshtein": sequence.token_distance,
    "align_edits": sequence.align_chars,
    "strip_gap": sequence.strip_gap,
}
TABLES = {"parse_textgrid": ParseTextGrid, "edit_steps": EditSteps}


def register(spark: SparkSession) -> None:
    """Make all of them known to `spark.sql` in this session."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    for name, f in TABLES.items():
        spark.udtf.register(name, f)
