"""Column functions on text, times and loosely typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions import vocabulary as V


def normalize(text: Column) -> Column:
    """Lower case, underscores and hyphens to spaces, white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "_-", "  "), r"\s+", " "))


def word(text: Column, words: list[str]) -> Column:
    """Whether any of the words stands in the text as a whole word."""
    return text.rlike(r"\b(" + "|".join(words) + r")\b")


def anywhere(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def safe_double(value: Column, default: float | None = None) -> Column:
    """The number in a value; the default for anything else and for NaN and infinities."""
    number = value.try_cast("double")
    number = F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)
    return number if default is None else F.coalesce(number, F.lit(default))


def safe_int(value: Column, default: int | None = None) -> Column:
    number = value.try_cast("double").try_cast("bigint")
    return number if default is None else F.coalesce(number, F.lit(default))


def clock(seconds: Column, always_hours: bool = False) -> Column:
    """[HH:]MM:SS.mmm of a media time, rounded to milliseconds before it is cut, so that no
    field overflows. Null and negative times: null with hours, else 00:00.000."""
    ms = F.round(seconds * 1000).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, s, f = F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, F.lpad((ms % 1000).cast("string"), 3, "0")
    short = F.concat(two(m), F.lit(":"), two(s), F.lit("."), f)
    long = F.concat(two(h), F.lit(":"), short)
    if always_hours:
        return F.when(seconds >= 0, long)
    return F.when(seconds.isNull() | (seconds < 0), F.lit("00:00.000")).when(h > 0, long).otherwise(short)


def csv_values(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def csv_ids(text: Column) -> Column:
    return F.array_compact(F.transform(csv_values(text), lambda x: x.try_cast("bigint")))


def slug(text: Column, default: str = "video") -> Column:
    """Letters and digits in lower case; spaces, hyphens and underscores as one underscore."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[-_\s]+", "_"), r"[^\p{L}\p{N}_]", "")
    out = F.regexp_replace(F.regexp_replace(kept, "_+", "_"), "^_|_$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit(default)).otherwise(out)


def repaired_json(response: Column) -> Column:
    """The outermost braces of a model's answer, without code fences and trailing commas."""
    body = F.regexp_extract(F.regexp_replace(response, "```(json)?", ""), r"(?s)(\{.*\})", 1)
    return F.regexp_replace(F.regexp_replace(body, r",\s*\}", "}"), r",\s*\]", "]")


def raw_json(response: Column) -> Column:
    return F.regexp_extract(response, r"(?s)(\{.*\})", 1)


def _synonyms(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def normal_color(color: Column) -> Column:
    low = F.lower(F.trim(color))
    return F.coalesce(F.try_element_at(_synonyms(V.COLOR_SYNONYMS), low), low)


def normal_attributes(attributes: Column) -> Column:
    names = _synonyms(V.ATTRIBUTE_SYNONYMS)
    low = F.transform(F.array_compact(attributes), lambda a: F.lower(F.trim(a)))
    return F.array_sort(F.array_distinct(F.transform(low, lambda a: F.coalesce(F.try_element_at(names, a), a))))


def clean_attributes(attributes: Column) -> Column:
    """Without stop values, in the order of their first appearance."""
    low = F.transform(F.array_compact(attributes), lambda a: F.lower(F.trim(a)))
    return F.array_distinct(F.filter(low, lambda a: ~a.isin(V.IGNORED_ATTRIBUTES)))


def clean_colors(colors: Column) -> Column:
    low = F.transform_values(F.map_filter(colors, lambda _, v: v.isNotNull()), lambda _, v: F.lower(F.trim(v)))
    return F.map_filter(low, lambda _, v: ~v.isin(V.IGNORED_COLORS))


def clean_action(action: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(action, F.lit(""))))
    return F.when(low.isin(V.IGNORED_ACTIONS), F.lit("")).otherwise(low)


def voice_language(text: Column) -> Column:
    return F.when(anywhere(F.lower(text), V.VOICE_ENGLISH), "en").otherwise("unknown")


def voice_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def hsv_color(h: Column, s: Column, v: Column) -> Column:
    """The name of a pixel's colour; hue 0 to 179, saturation and value 0 to 255."""
    hue = F.when((h < 10) | (h >= 170), "red").when(h < 22, "orange").when(h < 35, "yellow").when(h < 85, "green").when(h < 130, "blue").when(h < 160, "purple").otherwise("pink")
    return (
        F.when(v < 45, "black")
        .when((s < 35) & (v > 190), "white").when((s < 35) & (v > 65), "gray").when(s < 35, "black")
        .when((s < 70) & (v > 200), "white").when((s < 70) & (v > 80), "gray")
        .otherwise(hue)
    )
