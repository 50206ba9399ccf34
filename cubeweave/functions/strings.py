"""String functions over columns, with the semantics of Python's strings where they differ from SQL's."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\r\x0b\x0c"


def length(x: Column) -> Column:
    return F.char_length(x)


def get(x: Column, i: int, default: str = "") -> Column:
    """The i-th character, from the end if negative; ``default`` outside."""
    at = F.lit(i + 1) if i >= 0 else F.char_length(x) + i + 1
    return F.when((at >= 1) & (at <= F.char_length(x)), F.substring(x, at.cast("int"), F.lit(1))).when(x.isNotNull(), F.lit(default))


def _bound(x: Column, k: int | None, otherwise: Column) -> Column:
    if k is None:
        return otherwise
    n = F.char_length(x)
    return F.least(n, F.lit(k)) if k >= 0 else F.greatest(F.lit(0), n + k)


def slice_(x: Column, start: int | None = None, stop: int | None = None, step: int = 1) -> Column:
    """x[start:stop:step]."""
    n = F.char_length(x)
    if step == 1:
        a, b = _bound(x, start, F.lit(0)), _bound(x, stop, n)
        return F.substring(x, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    chars = F.split(x, "")
    if step > 0:
        a, b = _bound(x, start, F.lit(0)), _bound(x, stop, n)
        places = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i >= a) & (i < b) & ((i - a) % step == 0))
    else:
        a = F.least(n - 1, _bound(x, start, n - 1))
        b = _bound(x, stop, F.lit(-1))
        places = F.filter(F.sequence(F.greatest(n - 1, F.lit(0)), F.lit(0)), lambda i: (i <= a) & (i > b) & ((a - i) % -step == 0))
    return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(places, lambda i: F.get(chars, i)), ""))


def slice_replace(x: Column, start: int | None, stop: int | None, repl: str = "") -> Column:
    """x[:start] + repl + x[stop:]; an empty slice inserts."""
    n = F.char_length(x)
    a = _bound(x, start, F.lit(0))
    b = F.greatest(a, _bound(x, stop, n))
    return F.concat(F.substring(x, F.lit(1), a.cast("int")), F.lit(repl), F.substring(x, (b + 1).cast("int"), F.greatest(n - b, F.lit(0)).cast("int")))


def cat(x: Column, *others: Column | str, sep: str = "") -> Column:
    """Joined with others; missing if any is."""
    parts = [x, *[o if isinstance(o, Column) else F.lit(o) for o in others]]
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit(sep), p)
    return out


def join(value: str, order: str, sep: str = "") -> Column:
    """An aggregate: the group's strings in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]), sep)


def capitalize(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.char_length(x))))


def swapcase(x: Column) -> Column:
    return F.array_join(F.transform(F.split(x, ""), lambda c: F.when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c))), "")


def _each(func: Callable[[str], str], kind: str = "string") -> Callable[[Column], Column]:
    """A function of Python's strings, a few rows at a time: a worker never holds an Arrow batch of 10,000 whole texts."""
    return F.udf(lambda s: None if s is None else func(s), kind, useArrow=False)


def title(x: Column) -> Column:
    return _each(str.title)(x)


def casefold(x: Column) -> Column:
    return _each(str.casefold)(x)


def normalize(x: Column, form: str = "NFC") -> Column:
    return _each(lambda s: unicodedata.normalize(form, s))(x)


def wrap(x: Column, width: int) -> Column:
    import textwrap

    return _each(lambda s: "\n".join(textwrap.wrap(s, width)))(x)


def format_(pattern: str, *args: Column) -> Column:
    """printf-style formatting."""
    return F.format_string(pattern, *args)


#: Tests of all characters, as patterns; an empty string fails each.
TESTS = {
    "isalnum": r"^[\p{L}\p{N}]+$", "isalpha": r"^\p{L}+$", "isdecimal": r"^\p{Nd}+$", "isdigit": r"^[\p{Nd}²³¹]+$", "isnumeric": r"^\p{N}+$", "isspace": r"^\s+$",
}


def test(x: Column, name: str) -> Column:
    if name == "islower":
        return (x == F.lower(x)) & (x != F.upper(x))
    if name == "isupper":
        return (x == F.upper(x)) & (x != F.lower(x))
    if name == "istitle":
        return _each(str.istitle, "boolean")(x)
    return x.rlike(TESTS[name])


def _pattern(pat: str, case: bool = True, literal: bool = False) -> str:
    if literal:
        pat = "\\Q" + pat.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return pat if case else "(?iu)" + pat


def count(x: Column, pat: str, case: bool = True) -> Column:
    return F.regexp_count(x, F.lit(_pattern(pat, case)))


def contains(x: Column, pat: str, case: bool = True, regex: bool = True) -> Column:
    return x.contains(pat) if case and not regex else x.rlike(_pattern(pat, case, not regex))


def match(x: Column, pat: str, case: bool = True) -> Column:
    return x.rlike(_pattern(f"^(?:{pat})", case))


def pad(x: Column, width: int, side: str = "left", fillchar: str = " ") -> Column:
    """To ``width`` at least; never cuts, unlike SQL's padding."""
    if len(fillchar) != 1:
        raise TypeError("fillchar is one character")
    n = F.char_length(x)
    if side == "left":
        out = F.lpad(x, width, fillchar)
    elif side == "right":
        out = F.rpad(x, width, fillchar)
    else:
        # The odd character goes left if the width is odd, as in Python.
        total = width - n
        left = F.floor(total / 2) + F.when((total % 2 == 1) & (F.lit(width) % 2 == 1), 1).otherwise(0)
        out = F.concat(F.repeat(F.lit(fillchar), left.cast("int")), x, F.repeat(F.lit(fillchar), (total - left).cast("int")))
    return F.when(n < width, out).otherwise(x)


def zfill(x: Column, width: int) -> Column:
    return pad(x, width, "left", "0")


def strip(x: Column, chars: str | None = None, side: str = "both") -> Column:
    func = {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[side]
    return func(x, F.lit(BLANK if chars is None else chars))


def translate(x: Column, table: Mapping[str, str | None]) -> Column:
    """Characters to characters, or to nothing."""
    kept = {k: v for k, v in table.items() if v}
    gone = [k for k, v in table.items() if not v]
    return F.translate(x, "".join(kept) + "".join(gone), "".join(kept.values()))


def find(x: Column, sub: str, start: int = 0, side: str = "left") -> Column:
    """Place of the first (or last) occurrence, or -1."""
    if side == "left":
        return F.locate(sub, x, start + 1) - 1
    at = F.locate(sub[::-1], F.reverse(x))
    return F.when(at == 0, -1).otherwise(F.char_length(x) - at + 1 - len(sub))


def index(x: Column, sub: str, side: str = "left") -> Column:
    at = find(x, sub, 0, side)
    return F.when(at < 0, F.raise_error(F.lit("substring not found")).cast("int")).otherwise(at)


def replace(x: Column, pat: str, repl: str, n: int = -1, case: bool = True, regex: bool = True) -> Column:
    """All matches, or the first ``n``."""
    if n <= 0:
        return F.regexp_replace(x, _pattern(pat, case, not regex), repl if regex else repl.replace("\\", "\\\\").replace("$", "\\$")) if regex or not case else F.replace(x, F.lit(pat), F.lit(repl))
    import re

    compiled = re.compile(pat if regex else re.escape(pat), 0 if case else re.I)
    return _each(lambda s: compiled.sub(repl, s, count=n))(x)


def extract(x: Column, pat: str, groups: int, case: bool = True) -> Column:
    """The groups of the first match; empty where there is none."""
    return F.array(*[F.regexp_extract(x, _pattern(pat, case), k) for k in range(1, groups + 1)])


def extractall(x: Column, pat: str, groups: int, case: bool = True) -> Column:
    """Of each match, its groups."""
    parts = [F.regexp_extract_all(x, F.lit(_pattern(pat, case)), F.lit(k)) for k in range(1, groups + 1)]
    return F.transform(F.arrays_zip(*[p.alias(f"g{k}") for k, p in enumerate(parts)]), lambda s: F.array(*[s[f"g{k}"] for k in range(groups)]))


def findall(x: Column, pat: str, case: bool = True) -> Column:
    return F.regexp_extract_all(x, F.lit(_pattern(pat, case)), F.lit(0))


def partition(x: Column, sep: str = " ", side: str = "left") -> Column:
    """What stands before the separator, it, and what stands after."""
    at = find(x, sep, 0, side)
    before = F.when(at < 0, x if side == "left" else F.lit("")).otherwise(F.substring(x, F.lit(1), at.cast("int")))
    after = F.when(at < 0, F.lit("") if side == "left" else x).otherwise(F.substring(x, (at + len(sep) + 1).cast("int"), F.char_length(x)))
    return F.array(before, F.when(at < 0, F.lit("")).otherwise(F.lit(sep)), after)


def split(x: Column, sep: str, maxsplit: int = -1, side: str = "left") -> Column:
    """Parts between separators; at most ``maxsplit`` cuts, from the left or the right."""
    if side == "left":
        return F.split(x, _pattern(sep, literal=True), maxsplit + 1 if maxsplit > 0 else -1)
    parts = F.split(F.reverse(x), _pattern(sep[::-1], literal=True), maxsplit + 1 if maxsplit > 0 else -1)
    return F.reverse(F.transform(parts, lambda p: F.reverse(p)))


def get_dummies(frame: DataFrame, column: str, keys: Sequence[str], sep: str = "|") -> DataFrame:
    """(keys, label, value): whether each label that occurs anywhere is among a row's parts."""
    parts = frame.select(*keys, F.explode(F.array_distinct(F.split(column, _pattern(sep, literal=True)))).alias("label")).where("label <> ''")
    labels = parts.select("label").distinct()
    return frame.select(*keys).crossJoin(F.broadcast(labels)).join(parts.withColumn("value", F.lit(True)), [*keys, "label"], "left").select(*keys, "label", F.coalesce("value", F.lit(False)).alias("value"))


def repeat(x: Column, n: int | Column) -> Column:
    return F.repeat(x, n)


def encode(x: Column, charset: str = "UTF-8") -> Column:
    return F.encode(x, charset)


def decode(x: Column, charset: str = "UTF-8") -> Column:
    return F.decode(x, charset)
