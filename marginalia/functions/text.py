"""Text expressions: Unicode strip, row triage, tokens, row identity by text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

# The code points that count as blank, as a Java character class.
BLANK_CLASS = (
    r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
)

# Row status names.
NONE = "none"
EMPTY = "empty"
WHITESPACE = "whitespace"
NAN = "nan"
NON_TEXT = "non_text"
SKIP_REASONS = (NONE, EMPTY, WHITESPACE, NAN, NON_TEXT)

TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def strip(text: Column) -> Column:
    # The look-behind starts the trailing match at the head of a blank run, which keeps long
    # inner runs linear.
    return F.regexp_replace(text, f"^{BLANK_CLASS}+|(?<!{BLANK_CLASS}){BLANK_CLASS}+$", "")


def is_blank(text: Column) -> Column:
    """True for '' and for text made of blank characters only; null stays null."""
    # The first character settles nearly every text without a scan of the rest.
    return F.substring(text, 1, 1).rlike(f"^{BLANK_CLASS}?$") & text.rlike(f"^{BLANK_CLASS}*$")


def _string_reason(text: Column) -> Column:
    return (
        F.when(text == "", EMPTY)
        .when(is_blank(text), WHITESPACE)
        .when((F.octet_length(text) == 3) & (F.lower(text) == "nan"), NAN)
        .otherwise(NONE)
    )


def skip_reason(text: Column, null_reason: str = EMPTY, data_type: T.DataType | None = None) -> Column:
    """Why a row is left out of scoring, ``none`` when it is not.

    ``null_reason`` is ``empty`` for in-memory tables and ``nan`` for tables read from files.
    ``data_type`` is the column's type; it is needed only when the column is not a string.
    """
    if data_type is None or isinstance(data_type, T.StringType):
        reason = _string_reason(text)
    elif isinstance(data_type, T.VariantType):
        kind = F.schema_of_variant(text)
        as_string = F.try_variant_get(text, "$", "string")
        return (
            F.when(text.isNull() | (kind == "VOID"), null_reason)
            .when(kind == "STRING", _string_reason(as_string))
            .otherwise(NON_TEXT)
        )
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        reason = F.when(F.isnan(text), NAN).otherwise(NON_TEXT)
    else:
        reason = F.lit(NON_TEXT)
    return F.when(text.isNull(), null_reason).otherwise(reason)


def should_skip(reason: Column) -> Column:
    return reason != NONE


def tokens(text: Column, max_length: int | None = None) -> Column:
    """Lower-cased runs of letters and digits, the first ``max_length`` of them if given."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.slice(found, 1, max_length) if max_length else found


def padded(token_array: Column, length: int, pad: str = "") -> Column:
    missing = F.greatest(F.lit(length) - F.size(token_array), F.lit(0))
    return F.concat(token_array, F.array_repeat(F.lit(pad), missing))


def attention_mask(token_array: Column, length: int) -> Column:
    real = F.least(F.size(token_array), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.lit(length) - real))


def text_key(text: Column) -> Column:
    """An identity for a text that is never longer than 64 characters.

    Texts under 64 characters stand for themselves, longer ones for their 64-character
    SHA-256 digest, so the two kinds cannot meet and long texts are not shuffled.
    """
    return F.when(F.length(text) < 64, text).otherwise(F.sha2(text, 256))
