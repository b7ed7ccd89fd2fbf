"""Text functions: normalisation, admissibility, transcript cleaning, ids and paths."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Fixed values.
PROMPT_MARKERS = ("language Chinese", "<asr_text>", "<|")
SOURCE_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,80}$"
FULLWIDTH_LATIN = "[Ａ-Ｚａ-ｚ]"
CJK = "[一-鿿]"
SILENCE_MARK = r"(?i)<sil>|\(sil\)|sil|<space>|<_>|\s"
#: A character that neither a silence tag nor white space holds.
SPOKEN = r"(?U)[^<>()_silpaceSILPACE\s]"
OVERLAP_TAG = "/overlap"
ANNOTATION = r"(?i)<(?:sil|\s*%\s*|[-$#_]|space)>|\((?:~|sil)\)|[`&]"
#: What an annotation begins with.
ANNOTATION_HEAD = "[<(`&]"
SCENARIOS = ("clean", "noise", "reverb", "far_field", "dropout")


def fold(text: str) -> str:
    """NFKC, case folding, then without punctuation, separators and control characters."""
    plain = unicodedata.normalize("NFKC", text).casefold()
    return "".join(c for c in plain if not ((k := unicodedata.category(c))[0] in "PZ" or k == "Cc"))


@pandas_udf(StringType())
def normalize(text: pd.Series) -> pd.Series:
    """The scoring normal form of a text; null stays null."""
    return text.map(fold, na_action="ignore")


def normalize_fast(text: Column) -> Column:
    """`normalize` without leaving the JVM, for text whose only special folding is ß.

    Compatibility characters (full-width forms, ligatures) need `normalize`.
    """
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[\p{P}\p{Z}\p{Cc}]+", "")


def squeeze(text: Column) -> Column:
    """Without any Unicode white space; only what is left after blanks and line ends are gone needs a pattern."""
    plain = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return bound(plain, lambda t: F.when(t.rlike(r"(?U)\s"), F.regexp_replace(t, r"(?U)\s+", "")).otherwise(t))


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def first_of(*cases: tuple[Column, str]) -> Column:
    """The reason of the first condition that holds, else null; conditions that are null don't hold."""
    out = None
    for cond, reason in cases:
        out = F.when(cond, reason) if out is None else out.when(cond, reason)
    return out


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once a row, however often and under whatever condition it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_problem(text: Column) -> Column:
    """Why a transcript is not admissible, first reason wins; null if it is."""

    def judged(t: Column) -> Column:
        marked = F.lit(False)
        for m in PROMPT_MARKERS:
            marked = marked | F.contains(t, F.lit(m))
        return first_of(
            (is_blank(t), "empty_text"),
            (marked, "text_has_prompt_marker"),
            (t.rlike("[A-Za-z]"), "text_has_latin"),
            (~t.rlike(CJK), "text_not_chinese"),
        )

    return bound(text, judged)  # a filter would work the text out for each check


def is_active_speech(mark: Column) -> Column:
    """Whether an interval's mark is speech: not blank and not only silence tags.

    A character that no tag holds settles it. Else the tags are taken out one by one: a repeated
    group would recurse once a tag.
    """
    return mark.isNotNull() & (mark.rlike(SPOKEN) | (~is_blank(mark) & (F.regexp_replace(strip(mark), SILENCE_MARK, "") != "")))


def clean_transcript(raw: Column, least: int = 2, reject_latin: bool = True, reject_overlap: bool = True, norm=normalize) -> Column:
    """struct(text, reason) of an annotated interval, checks in order; one of the two is null."""

    def judged(text: Column, short: Column) -> Column:
        markers = F.lit(False)
        for m in PROMPT_MARKERS:
            # what is left of the text has no white space, so a marker with a blank never occurs in it
            if " " not in m:
                markers = markers | has_folded(text, m.lower())
        reason = first_of(
            (~is_active_speech(raw), "silence_interval"),
            (F.lit(reject_overlap) & has_folded(raw, OVERLAP_TAG), "overlap_tag"),
            (text == "", "empty_after_tag_strip"),
            (markers, "forbidden_prompt_token"),
            (F.lit(reject_latin) & text.rlike("[A-Za-zＡ-Ｚａ-ｚ]"), "contains_latin_code_switch"),
            (~text.rlike(CJK), "no_cjk_char"),
            (short, "empty_or_too_short_text"),
        )
        return bound(reason, lambda r: F.struct(F.when(r.isNull(), text).alias("text"), r.alias("reason")))

    text = squeeze(F.when(raw.rlike(ANNOTATION_HEAD), F.regexp_replace(raw, ANNOTATION, "")).otherwise(raw))
    if norm is normalize_fast:  # only for the texts that come to the last check
        return bound(text, lambda t: judged(t, F.length(norm(t)) < least))
    # the normal form may be a Python function, which a lambda can't hold
    return bound(F.struct(text.alias("text"), (F.length(norm(text)) < least).alias("short")), lambda x: judged(x["text"], x["short"]))


def has_folded(text: Column, part: str) -> Column:
    """Whether the lower-cased text has `part`, which begins with a character without case."""
    return F.contains(text, F.lit(part[0])) & F.contains(F.lower(text), F.lit(part))


def meeting_id(name: Column) -> Column:
    """The first two non-empty parts between underscores; a name without two stays."""
    parts = F.filter(F.split(strip(name), "_"), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 1, 2), "_")).otherwise(strip(name))


def speaker_token(name: Column) -> Column:
    """The SPK token in upper case; null if there is none."""
    return F.nullif(F.upper(F.regexp_extract(name, r"(?i)(SPK[A-Za-z0-9]+)", 1)), F.lit(""))


def utterance_speaker(utterance: Column) -> Column:
    """Speaker of an id BAC009Sdddd W...: characters 7 to 11, if they are S and four digits."""
    speaker = F.substring(utterance, 7, 5)
    return F.when(utterance.startswith("BAC009S") & F.contains(utterance, F.lit("W")) & speaker.rlike("^S[0-9]{4}$"), speaker)


def generation_text(raw: Column) -> Column:
    """What a decoder said: end tokens gone, after the first <asr_text>, stripped."""
    plain = strip(F.replace(F.replace(raw, F.lit("<|im_end|>"), F.lit("")), F.lit("<|endoftext|>"), F.lit("")))
    said = F.regexp_extract(plain, r"(?s)^.*?<asr_text>(.*)$", 1)
    return strip(F.when(F.contains(plain, F.lit("<asr_text>")), said).otherwise(plain))


def stop_reason(ids: Column, eos: int, limit: int) -> Column:
    """eos if the last id is the end id, length if the limit is reached, else other."""
    return F.when(F.get(ids, F.size(ids) - 1) == eos, "eos").when(F.size(ids) >= limit, "length").otherwise("other")


def char_token_count(text: Column) -> Column:
    return F.length(text) + 1


def has_punctuation(text: Column, norm=normalize) -> Column:
    return (text == "") | (norm(text) != text)


def is_safe_path(path: Column) -> Column:
    """Relative, without backslashes and parent steps."""
    return (path != "") & ~path.rlike(r"^/|\\") & ~F.array_contains(F.split(path, "/"), "..")


def is_source_id(x: Column) -> Column:
    return x.rlike(SOURCE_ID)


def sample_id(source: Column, scenario: Column) -> Column:
    return F.concat(source, F.lit("__"), scenario)


def interval_id(meeting: Column, speaker: Column, begin: Column, end: Column) -> Column:
    """Id of a meeting interval, times in hundredths of a second, seven digits."""
    cs = lambda t: F.lpad(F.rint(t * 100).cast("long").cast("string"), 7, "0")
    return F.concat_ws("_", F.lit("alimeeting"), meeting, speaker, cs(begin), cs(end))


def visit_id(epoch: Column, visit: Column, sample: Column) -> Column:
    return F.concat(F.lit("ep"), F.lpad(epoch.cast("string"), 3, "0"), F.lit("_v"), F.lpad(visit.cast("string"), 6, "0"), F.lit("_"), sample)


def step_name(step: Column) -> Column:
    return F.concat(F.lit("step_"), F.lpad(step.cast("string"), 6, "0"))
