"""Text, tag and model-answer functions (all JVM-side)."""

import re

from pyspark.sql import Column, functions as F

from memlake.constants import ENTRY_TYPES, GATE_LABELS

# Fixed patterns: the answer format models are asked for.
FENCED_JSON = r"(?sU)```(?:json)?\s*(\{.*?\})\s*```"
BARE_JSON = r"(?s)\{.*\}"

# Fixed set: every character that counts as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_WORD, _GAP = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"
_DIGITS = r"\d+(?:_\d+)*"
_NUMBER = (
    rf"(?i)^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    r"|inf|infinity|nan)$"
)


def strip(text) -> Column:
    """Drop leading and trailing white space of any Unicode kind."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(strip(text) == "", F.lit(True))


def json_block(raw) -> Column:
    """The JSON object inside a model answer, or null when there is none.

    A fenced block wins; otherwise everything from the first to the last brace.
    """
    fenced = F.regexp_extract(raw, FENCED_JSON, 1)
    bare = F.regexp_extract(raw, BARE_JSON, 0)
    return F.when(fenced != "", fenced).when(bare != "", bare)


def parse_answer(raw) -> Column:
    """Model answer -> variant object; null when nothing parses."""
    return F.try_parse_json(json_block(raw))


def _member(answer: Column, key: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(answer, f"$.{key}", as_type)


def _kind(value: Column) -> Column:
    """STRING, BIGINT, DOUBLE, DECIMAL(..), BOOLEAN, VOID, ARRAY<..>, OBJECT<..> or null."""
    return F.schema_of_variant(value)


def _as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def parse_float(text) -> Column:
    """Text -> double under the rules of a decimal literal; null when it is not a number."""
    clean = strip(text)
    return F.when(
        clean.rlike(_NUMBER), F.regexp_replace(clean, "_", "").try_cast("double")
    )


def gate_label(answer: Column) -> Column:
    """Normalised label; null when the label is present but not a string."""
    value = _member(answer, "label")
    label = F.lower(strip(_as_text(value)))
    return (
        F.when(value.isNull(), "uncertain")
        .when(_kind(value) != "STRING", F.lit(None))
        .when(label.isin(*GATE_LABELS), label)
        .otherwise("uncertain")
    )


def gate_confidence_kind(answer: Column) -> Column:
    """'fatal' for null and containers, 'bad' for text that is no number, else 'good'."""
    value = _member(answer, "confidence")
    kind = _kind(value)
    return (
        F.when(value.isNull(), "good")
        .when((kind == "VOID") | kind.startswith("ARRAY") | kind.startswith("OBJECT"), "fatal")
        .when((kind == "STRING") & parse_float(_as_text(value)).isNull(), "bad")
        .otherwise("good")
    )


def gate_confidence(answer: Column) -> Column:
    """Confidence clamped to [0, 1]; 0.5 when missing; NaN counts as 1."""
    value = _member(answer, "confidence")
    kind = _kind(value)
    number = (
        F.when(value.isNull(), F.lit(0.5))
        .when(kind == "STRING", parse_float(_as_text(value)))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
        .otherwise(F.try_variant_get(value, "$", "double"))
    )
    return F.when(
        number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))
    )


def gate_reason(answer: Column) -> Column:
    value = _member(answer, "reason")
    return (
        F.when(value.isNull(), "")
        .when(_kind(value) == "VOID", "None")
        .otherwise(_as_text(value))
    )


def entry_type(answer: Column) -> Column:
    """Normalised entry type; missing, unknown and non-text values are observations."""
    value = _member(answer, "entry_type")
    name = F.lower(strip(_as_text(value)))
    return F.when(
        (_kind(value) == "STRING") & name.isin(*ENTRY_TYPES), name
    ).otherwise("observation")


def tag_list(answer: Column, key: str) -> Column:
    """A list member as stripped, non-blank strings. Order and repeats are kept.

    Falsy elements (null, false, zero, empty) are dropped; other non-strings keep
    Spark's text form.
    """
    items = F.filter(
        _member(answer, key, "array<variant>"),
        lambda v: ~F.is_variant_null(v)
        & ~(
            (_kind(v) != "STRING")
            & F.coalesce(
                _as_text(v).isin("false", "[]", "{}")
                | (F.try_variant_get(v, "$", "double") == 0.0),
                F.lit(False),
            )
        ),
    )
    texts = F.filter(
        F.transform(items, lambda v: strip(_as_text(v))), lambda t: F.length(t) > 0
    )
    return F.coalesce(texts, F.array().cast("array<string>"))


def iso_timestamp(ts, zoned: bool = True) -> Column:
    """ISO 8601 text; a fraction only when there is one; UTC offset for zoned values."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    text = F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    return F.concat(text, F.lit("+00:00")) if zoned else text


def memory_text(entry_type, topics, created_at, raw_text) -> Column:
    """One memory as '[type] Topics: a, b (date)' over its text; empty parts left out."""
    names = F.array_join(topics, ", ")
    return F.concat(
        F.lit("["), F.coalesce(entry_type, F.lit("unknown")), F.lit("]"),
        F.when(F.coalesce(names, F.lit("")) != "", F.concat(F.lit(" Topics: "), names)).otherwise(""),
        F.coalesce(
            F.concat(F.lit(" ("), F.date_format(created_at, "yyyy-MM-dd"), F.lit(")")), F.lit("")
        ),
        F.lit("\n"),
        F.coalesce(raw_text, F.lit("")),
    )


def words(text) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), f"{_GAP}+"), lambda w: F.length(w) > 0)


def has_words(text, n: int) -> Column:
    """True when the text has at least n words; stops reading at the n-th."""
    return F.rlike(text, F.lit(f"^{_GAP}*+(?:{_WORD}++{_GAP}++){{{n - 1}}}{_WORD}"))


def spaced(text) -> Column:
    """The words of a text, each with a space before and behind it."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), f"{_GAP}+", " "), F.lit(" "))


def filled(template: str, **parts) -> Column:
    """A text with columns in place of the {names} of a template."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[parts[x] if i % 2 else F.lit(x) for i, x in enumerate(pieces) if x])
