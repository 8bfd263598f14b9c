"""Label expressions: parsing one cell, combining cells, masks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from .columns import named
from .text import strip

# One element of a list written as text: a quoted string, a number or a named constant.
_ELEMENT = (
    r"(?:'(?:[^'\\]|\\.)*'"
    r'|"(?:[^"\\]|\\.)*"'
    r"|[+-]?[0-9]+(?:\.[0-9]+)?"
    r"|None|True|False)"
)
_LIST = rf"(?s)^\[\s*(?:{_ELEMENT}\s*(?:,\s*{_ELEMENT}\s*)*(?:,\s*)?)?\]$"
_QUOTED = r"""(?s)^['"](.*)['"]$"""


def empty_labels() -> Column:
    return F.array().cast("array<string>")


def clean(items: Column) -> Column:
    """Strip every element; drop nulls and elements that were blank."""
    return F.filter(F.transform(items, strip), lambda item: item.isNotNull() & (item != ""))


def split_on(text: Column, separator: str) -> Column:
    return clean(F.split(text, "\\" + separator))


def _unquote(element: Column) -> Column:
    inner = F.regexp_extract(element, _QUOTED, 1)
    for written, meant in ((r"\\n", "\n"), (r"\\t", "\t"), (r"\\r", "\r")):
        inner = F.regexp_replace(inner, rf"(?<!\\){written}", meant)
    inner = F.regexp_replace(inner, r"\\(['\"\\])", "$1")
    number = F.when(
        element.rlike(r"^[+-]?[0-9]+\.[0-9]+$"), element.try_cast("double").cast("string")
    ).when(element.rlike(r"^[+-]?[0-9]+$"), F.regexp_replace(element, r"^\+", ""))
    return F.when(element.rlike(_QUOTED), inner).otherwise(F.coalesce(number, element))


def parse_label_cell(raw: Column, data_type: T.DataType | None = None) -> Column:
    """One cell to ``array<string>``.

    Arrays are cleaned, numbers become their text, a list written as text is read as a list,
    otherwise the first separator present out of ``|`` ``,`` ``;`` splits the cell.
    """
    if isinstance(data_type, T.ArrayType):
        return F.coalesce(clean(raw.cast("array<string>")), empty_labels())
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        present = raw.isNotNull() & ~F.isnan(raw)
        return F.when(present, F.array(raw.cast("string"))).otherwise(empty_labels())
    if isinstance(data_type, T.NumericType):
        return F.when(raw.isNotNull(), F.array(raw.cast("string"))).otherwise(empty_labels())
    text = strip(raw.cast("string"))
    listed = clean(F.transform(F.regexp_extract_all(text, F.lit(_ELEMENT), F.lit(0)), _unquote))
    return (
        F.when(text.isNull() | (text == ""), empty_labels())
        .when(text.rlike(_LIST), listed)
        .when(text.contains("|"), split_on(text, "|"))
        .when(text.contains(","), split_on(text, ","))
        .when(text.contains(";"), split_on(text, ";"))
        .otherwise(F.array(text))
    )


def combine_cells(columns: Sequence[str]) -> Column:
    """Non-blank cells of ``columns`` in the given order."""
    return clean(F.array(*[named(name).cast("string") for name in columns]))


#: Vocabularies up to this size become one expression per label, from which single entries are taken for free.
WRITTEN_OUT = 64


def multi_hot(labels: Column, vocabulary: Sequence[str]) -> Column:
    """0/1 per vocabulary entry; repeats collapse and unknown labels are ignored."""
    if not vocabulary:
        return F.array().cast("array<int>")
    if len(vocabulary) <= WRITTEN_OUT:
        return F.array(
            *[F.coalesce(F.array_contains(labels, name).cast("int"), F.lit(0)) for name in vocabulary]
        )
    return F.transform(
        name_array(vocabulary), lambda name: F.coalesce(F.array_contains(labels, name).cast("int"), F.lit(0))
    )


def name_array(names: Sequence[str]) -> Column:
    """The names as one constant, however many there are."""
    return F.from_json(F.lit(json.dumps(list(names))), "array<string>")


def from_mask(mask: Column, vocabulary: Sequence[str]) -> Column:
    """Names of the entries whose mask is true, in vocabulary order."""
    named_mask = F.arrays_zip(name_array(vocabulary).alias("name"), mask.alias("chosen"))
    return F.transform(F.filter(named_mask, lambda x: x["chosen"]), lambda x: x["name"])


def label_at(labels: Column, index: int) -> Column:
    return F.coalesce(F.get(labels, F.lit(index)), F.lit(""))


def pair_summary(pairs: Column, key: str, value: str) -> Column:
    """``k=v, k=v`` sorted by key, from an array of structs."""
    written = F.transform(pairs, lambda p: F.concat_ws("=", p[key], p[value].cast("string")))
    return F.array_join(F.array_sort(written), ", ")
