"""Normalisation, quality flags and binning as Column expressions; NFKC alone needs an Arrow UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: fixed values: white space as the normaliser understands it, the marker at a reference's start, and the characters removed
SPACE = r"(?U)[\s\x1c-\x1f]"
MARKER = r"(?U)^\[(?:RAW|NORM)\][\s\x1c-\x1f]*"
PUNCTUATION = r"[，。！？；：、“”‘’（）()【】《》〈〉—…·,.!?;:\"'`\[\]{}]"

#: traditional to simplified characters (a small pinned table, not a full conversion)
TRADITIONAL = "發學會個這來時說國對開們為東車馬門問間聽買賣讀寫話語請謝後點錢電腦機飛氣樂應該見現視頭髮長樣歡愛"
SIMPLIFIED = "发学会个这来时说国对开们为东车马门问间听买卖读写话语请谢后点钱电脑机飞气乐应该见现视头发长样欢爱"


def to_simplified(text: Column) -> Column:
    """Character by character with the pinned table."""
    return F.translate(text, TRADITIONAL, SIMPLIFIED)


def normalize_reference(text: Column) -> Column:
    """Drops a leading marker, then punctuation and white space. No script conversion."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, MARKER, ""), PUNCTUATION, ""), SPACE, "")


def normalize_prediction(text: Column) -> Column:
    """P2, then P1; asymmetric with P1 by intent."""
    return normalize_reference(to_simplified(text))


def normalize_competition(text: Column) -> Column:
    """Null counts as empty."""
    return normalize_prediction(F.coalesce(text, F.lit("")))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SPACE + "+", " "), "^ | $", "")


def clean_text(text: Column) -> Column:
    """NFKC, runs of white space to one space, trimmed."""
    return collapse_space(nfkc(text))


def normalize_training_text(text: Column) -> Column:
    """P5: NFKC, simplified, white space collapsed; punctuation stays."""
    return collapse_space(to_simplified(nfkc(text)))


def leakage_key(text: Column) -> Column:
    """Equality key for contamination."""
    return normalize_prediction(clean_text(text))


def normalize_id(value: Column) -> Column:
    """Whole numbers, also written with .0, without leading zeros; anything else is empty."""
    digits = F.regexp_extract(F.regexp_replace(value.cast("string"), r"^\s+|\s+$", ""), r"^(\d+)(?:\.0+)?$", 1)
    return F.when(digits == "", "").otherwise(F.regexp_replace(digits, r"^0+(?=\d)", ""))


def leading_id(path: Column) -> Column:
    """Exactly the five digits that a file name starts with."""
    return F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^\s*(\d{5})", 1)


def abnormal_unicode(text: Column) -> Column:
    """P10: a replacement character, or a control, surrogate or private-use character other than tab, line feed, carriage return."""
    return text.rlike(r"\x{FFFD}|[\p{Cc}\p{Cs}\p{Co}&&[^\t\n\r]]")


def abnormal_reasons(text: Column) -> Column:
    """Why a text is abnormal, in fixed order."""
    rules = (
        (F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "") == "", "empty_text"),
        (text.rlike(r"\x{FFFD}"), "unicode_replacement_character"),
        (text.rlike(r"[\p{Cc}\p{Cs}&&[^\t\n\r]]"), "control_or_surrogate_character"),
        (text.rlike(r"([，。！？,.!?;；])\1{7}"), "punctuation_run"),
    )
    return reasons(rules)


def reasons(rules: tuple[tuple[Column, str], ...]) -> Column:
    """The names of the rules that hold, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(name)) for c, name in rules)), lambda x: x.isNotNull())


def abnormal_characters(text: Column) -> Column:
    """Number of replacement characters and of controls below 32 other than tab, line feed, carriage return."""
    return (F.length(text) - F.length(F.regexp_replace(text, r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]", ""))).cast("long")


RUN = r"(.)\1{7}"


def _cycle(widths: range) -> str:
    return "|".join(f"(.{{{w}}})\\{k}{{3}}" for k, w in enumerate(widths, 1))


def _tail(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.substring(text, -size, size)).otherwise(text)


def compact(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def repeated_phrase(text: Column) -> Column:
    """A run of eight, or four copies of a unit of 2 to 4 characters at or after a start that lies over 120 before the end."""
    c = compact(text)
    return c.rlike("(?s)" + RUN) | c.rlike("(?s)" + "|".join(f"(?=(.{{{w}}}))(?=.{{121}}).*?\\{k}{{4}}" for k, w in enumerate((2, 3, 4), 1)))


def repeated_runaway(text: Column) -> Column:
    """A run of eight, or four copies of a unit of 2 to 12 characters within the last 120."""
    c = compact(text)
    return c.rlike("(?s)" + RUN) | _tail(c, 120).rlike("(?s)" + _cycle(range(2, 13)))


def long_text_cycle(text: Column) -> Column:
    """A run of eight, or four copies of a unit of 2 to 4 characters within the last 160; struct kind, width, unit, or null."""
    c = compact(text)
    run = F.regexp_extract(c, "(?s)" + RUN, 1)
    cases = F.when(run != "", F.struct(F.lit("character").alias("kind"), F.lit(1).alias("width"), run.alias("unit")))
    for w in (2, 3, 4):
        unit = F.regexp_extract(_tail(c, 160), f"(?s)(.{{{w}}})\\1{{3}}", 1)
        cases = cases.when(unit != "", F.struct(F.lit("phrase").alias("kind"), F.lit(w).alias("width"), unit.alias("unit")))
    return cases


def marker_flags(text: Column) -> dict[str, Column]:
    """Latin, digits, code switching (Latin with Han)."""
    latin, han = text.rlike("[A-Za-z]"), text.rlike(r"[\x{3400}-\x{9FFF}]")
    return {"has_latin": latin, "has_digit": text.rlike(r"(?U)\d"), "has_code_switch": latin & han}


def has_any(text: Column, needles: list[str]) -> Column:
    """Any of the markers occurs."""
    found = F.lit(False)
    for n in needles:
        found = found | text.contains(n)
    return found


def classify(value: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the first pattern found; without `otherwise` an unknown value is an error."""
    first, *rest = rules
    case = F.when(value.rlike(first[0]), first[1])
    for pattern, label in rest:
        case = case.when(value.rlike(pattern), label)
    return case.otherwise(F.raise_error(F.concat(F.lit("unknown value: "), value)) if otherwise is None else F.lit(otherwise))


def half_open_bin(value: Column, edges: list[float], prefix: str) -> Column:
    """`prefix_below_a`, `prefix_a_b`, `prefix_b_plus`; each bin holds its lower edge."""
    case = F.when(value < edges[0], F.lit(f"{prefix}_below_{edges[0]:g}"))
    for a, b in zip(edges, edges[1:]):
        case = case.when(value < b, F.lit(f"{prefix}_{a:g}_{b:g}"))
    return case.otherwise(F.lit(f"{prefix}_{edges[-1]:g}_plus"))


def mean_present(*columns: Column) -> Column:
    """Mean of the values that are present and finite, else 0."""
    values = F.filter(F.array(*(c.cast("double") for c in columns)), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(F.lit(0.0))


def valid_duration(value: Column, most: float) -> Column:
    """Finite, over 0, at most `most`."""
    return F.coalesce(~F.isnan(value) & (value > 0) & (value <= most), F.lit(False))


def scene_label(scene: Column) -> Column:
    """The leading number, else the first eight characters."""
    number = F.regexp_extract(scene, r"^\s*(\d+)", 1)
    return F.when(number != "", number).otherwise(F.substring(scene, 1, 8))


def checkpoint_step(name: Column) -> Column:
    """P25: the number of `checkpoint-<n>`, else null."""
    return F.regexp_extract(name, r"checkpoint-(\d+)$", 1).try_cast("long")


def unicode_audit(text: Column) -> dict[str, Column]:
    """Summed over rows."""
    return {
        "nfkc_changed": F.sum((nfkc(text) != text).cast("long")),
        "controls": F.sum(F.length(text) - F.length(F.regexp_replace(text, r"\p{Cc}", ""))),
        "replacements": F.sum(F.length(text) - F.length(F.regexp_replace(text, r"\x{FFFD}", ""))),
    }


def worst_case(*fields: Column, worst: float) -> Column:
    """The first present field, or a value that fails every veto."""
    return F.coalesce(*(f.cast("double") for f in fields), F.lit(worst))


def stable_digest(*parts: Column | str) -> Column:
    """M8: SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts)), 256)


def first_filled(*fields: Column) -> Column:
    """Fallback chain that skips nulls and empty strings."""
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in fields), F.lit(""))


def first_present(*fields: Column) -> Column:
    """Fallback chain that skips nulls alone."""
    return F.coalesce(*fields)
