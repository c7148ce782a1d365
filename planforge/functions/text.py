"""Normalisation of drawing texts as expressions.

`\\s` and `\\d` are meant for all of Unicode, hence `(?U)`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SENTINELS = ("LLM沒有東西", "LLM看不出來")
SYNONYMS = {"e.f": "E.F.", "ef": "E.F.", "E.F": "E.F.", "EF": "E.F."}
FOLDED = ("（）×ＸX", "()xxx")
DIMENSION = r"(?U)\d+\s*[xX×*]\s*\d+"


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def normalize_text(s: Column) -> Column:
    """Null and the sentinels become empty; characters are folded, dimensions dropped, marks brought to one form."""
    t = F.regexp_replace(F.translate(strip(s), *FOLDED), r"(?U)\s+", " ")
    pure = t.rlike(r"(?U)^\s*\(?\s*\d+\s*[xX*]\s*\d+\s*\)?\s*$")
    plain = strip(F.regexp_replace(t, r"(?U)\s*\(\s*\d+\s*[xX*]\s*\d+\s*\)", ""))
    t = F.when(pure, strip(F.translate(t, "()", ""))).otherwise(plain)
    t = F.regexp_replace(t, r"(?U)((?:R|B?\d+)[Ff])([A-Za-z])", "$1 $2")
    t = F.regexp_replace(t, r"(?U)\(\s*[Ee]\.?[Ff]\.?\s*\)", "(E.F.)")
    t = F.regexp_replace(t, r"(?U)(\S)\(E\.F\.\)", "$1 (E.F.)")
    t = F.regexp_replace(t, r"(?U)_\s*\(E\.F\.\)", " (E.F.)")
    t = F.regexp_replace(t, r"(?U)(?<!-)(\d+)\s*(#\d+)", "$1-$2")
    t = F.regexp_replace(t, r"(?U)\s*\(重複-\d+\)\s*$", "")
    names = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    t = F.coalesce(names[t], t)
    return F.when(s.isNull() | s.isin(*SENTINELS), "").otherwise(t)


def rebar_key(item: Column) -> Column:
    """Minus the count of `count-#number` items; 0 for all others."""
    count = F.regexp_extract(item, r"(?U)^(\d+)-#", 1)
    return F.when(count != "", -count.cast("long")).otherwise(0)


def normalize_list(items: Column) -> Column:
    """Normalised, without empty ones and repeats (the first stays), rebar counts from high to low, others last; stable."""
    texts = F.filter(F.transform(F.filter(items, lambda x: x.isNotNull() & (x != "")), normalize_text), lambda x: x != "")
    keyed = F.transform(F.array_distinct(texts), lambda x, i: F.struct(rebar_key(x).alias("key"), i.alias("pos"), x.alias("item")))
    return F.coalesce(F.transform(F.array_sort(keyed), lambda x: x["item"]), F.array().cast("array<string>"))


def normalize_struct(column: Column, kind) -> Column:
    """A typed record: strings and the strings and records of lists are normalised, records in turn; nested lists and other values stay."""
    from pyspark.sql import types as T

    if isinstance(kind, T.StringType):
        return normalize_text(column)
    if isinstance(kind, T.StructType):
        return F.struct(*(normalize_struct(column[f.name], f.dataType).alias(f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StringType, T.StructType)):
        return F.transform(column, lambda x: normalize_struct(x, kind.elementType))
    return column


def is_title_candidate(s: Column) -> Column:
    t = strip(s)
    return (F.length(t) >= 2) & ~t.rlike("[@#]") & (t.rlike(DIMENSION) | t.rlike("[A-Za-z]"))


def has_dimension(s: Column) -> Column:
    return s.rlike(DIMENSION)


def dimension_count(s: Column) -> Column:
    return F.size(F.regexp_extract_all(s, F.lit(DIMENSION), F.lit(0)))


def is_heuristic_title(s: Column) -> Column:
    return s.rlike("[a-zA-Z0-9_-]+") & s.rlike(r"\([0-9]+[xX*][0-9]+\)")


def id_list(answer: Column) -> Column:
    """The integers between the first `[` and the last `]` of a classifier's answer; null if that is no list."""
    first = F.locate("[", answer)
    last = F.length(answer) - F.locate("]", F.reverse(answer)) + 1
    inside = F.when((first > 0) & (F.locate("]", answer) > 0) & (last > first), F.substring(answer, first, last - first + 1))
    return F.from_json(inside, "array<int>")


def fixed(x: Column, digits: int) -> Column:
    """A non-negative number with so many decimals, at most six, rounded from its exact binary value; a tie goes to the even digit.

    format_string rounds the shortest decimal form, ties upward. Here 64 binary digits of the fraction are multiplied in
    two halves, so each product fits a long.
    """
    word, mask, scale = 2.0**32, (1 << 32) - 1, 10**digits
    whole = F.floor(x)
    high = F.floor((x - whole) * word)
    rest = ((x - whole) * word - high) * word
    low = F.floor(rest)
    bottom = low * scale
    top = high * scale + F.shiftright(bottom, 32)
    n, left = F.shiftright(top, 32), top.bitwiseAND(F.lit(mask))
    below = bottom.bitwiseAND(F.lit(mask)).cast("double") + (rest - low)
    half = F.lit(1 << 31)
    up = (left > half) | ((left == half) & ((below > 0) | (n % 2 == 1)))
    n = n + up.cast("long")
    return F.concat((whole + F.floor(n / scale)).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))
