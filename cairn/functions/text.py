"""Column expressions over strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Default tokenizer: runs of letters, lower-cased."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"\p{L}+"), F.lit(0))


def split_keep(text: Column | str, delimiter: str) -> Column:
    """Split on the exact delimiter; empty fields are kept."""
    import re

    return F.split(_col(text), re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", delimiter), -1)


def split_drop(text: Column | str, characters: str) -> Column:
    """Split on any of ``characters``; empty fields are dropped."""
    import re

    return F.filter(F.split(_col(text), "[" + re.sub(r"([\\\]\[^&-])", r"\\\1", characters) + "]"), lambda x: x != "")


def join(parts: Column | str, delimiter: str) -> Column:
    return F.array_join(_col(parts), delimiter)


def sentences(text: Column | str) -> Column:
    """Sentences ended by the ideographic full stop."""
    return F.split(_col(text), "。")


def page_keyword(title: Column | str) -> Column:
    """The keyword of a page title or link target, or null where it is not admissible.

    Not admissible: null, empty, "0"; with any of ``: | [ ]``, TAB or newline; beginning with # or white space;
    ending in 一覧 (list); a year. A trailing parenthesis is cut from its first "(" on.
    """
    t = _col(title)
    cut = F.regexp_replace(t, r"\s*\(.+?\)$", "")
    bad = t.isNull() | t.isin("", "0") | t.rlike(r"[:|\n\t\[\]]") | t.rlike(r"^[#\s]") | (cut == "") | cut.rlike("一覧$") | cut.rlike(r"^\d{4}年$")
    return F.when(~bad, cut)


def extension(path: Column | str) -> Column:
    """The part of the file name after its last dot, empty where there is none."""
    return F.regexp_extract(_col(path), r"\.([^./]*)$", 1)


def parent_directory(path: Column | str) -> Column:
    return F.try_element_at(F.split(_col(path), "/"), F.lit(-2))


def to_int(text: Column | str) -> Column:
    """The leading integer of a string, 0 where there is none."""
    return F.coalesce(F.regexp_extract(_col(text), r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))


def to_double(text: Column | str) -> Column:
    """The leading number of a string, 0 where there is none."""
    return F.coalesce(F.regexp_extract(_col(text), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


#: How a number may be spelled; words such as nan or inf, suffixes and thousands marks are none.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def strict_number(text: Column | str) -> Column:
    """The finite number that a whole string spells, else null."""
    t = _col(text)
    value = F.when(t.rlike(NUMBER), F.trim(t).try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)
