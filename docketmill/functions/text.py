"""Column functions over text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: Number words up to ninety-nine, made by rule.
NUMBERS = {w: i for i, w in enumerate(_ONES)} | {t: 20 + 10 * i for i, t in enumerate(_TENS)} | {f"{t}-{_ONES[k]}": 20 + 10 * i + k for i, t in enumerate(_TENS) for k in range(1, 10)}


def squashed(text: Column) -> Column:
    """Typographic quotes and dashes made plain, white space runs one blank, ends trimmed."""
    plain = F.translate(text, "‘’“”–— ", "''\"\"-- ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, or of one of its groups, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def count_of(text: Column, pattern: str) -> Column:
    return F.size(all_of(text, pattern))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value, which is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def inside_quotes(text: Column, at: Column) -> Column:
    """Whether a 1-based position lies inside double quotes: an odd number of them stands before it."""
    before = F.substring(text, 1, at - 1)
    return (F.length(before) - F.length(F.replace(before, F.lit('"'), F.lit("")))) % 2 == 1


def token_around(text: Column, at: Column) -> Column:
    """The run of anything but blanks that covers a 1-based position."""
    left = F.substring_index(F.substring(text, 1, at - 1), " ", -1)
    right = F.substring_index(F.substring(text, at, F.length(text)), " ", 1)
    return F.concat(left, right)


#: Words that multiply what stands before them, greatest first, and a pattern of numbers in words.
SCALES = {"billion": 10**9, "million": 10**6, "thousand": 10**3}
_WORD = "(?:" + "|".join(sorted([*_ONES, *_TENS, "hundred", *SCALES], key=len, reverse=True)) + ")"
IN_WORDS = rf"{_WORD}(?:(?: and |[ -]){_WORD})*"


_below_100 = rf"(?:(?:{'|'.join(_TENS)})(?: (?:{'|'.join(_ONES[1:10])}))?|{'|'.join(reversed(_ONES[1:]))})"
_below_1000 = rf"(?:(?:{_below_100} )?hundred(?: {_below_100})?|{_below_100})"
#: What is a number, of words with one blank after each and without "and": each scale once and in order, a number below a
#: thousand before each, tens before ones.
NUMBER = "^(?:zero |" + "".join(rf"(?:(?:{_below_1000} )?{s} )?" for s in SCALES) + rf"(?:{_below_1000} )?)$"


def number_words(words: Column) -> Column:
    """A number's words in lower case with one blank after each, without hyphens and "and"."""
    return F.regexp_replace(F.regexp_replace(F.concat(F.lower(F.trim(words)), F.lit(" ")), r"[\s-]+", " "), r"\band ", "")


def number_of(words: Column) -> Column:
    """The value of a number in words, up to billions, else null: hundreds multiply what stands before them, a greater
    scale all since the last one. Number words in a row that are no number, like nine and ten, have no value."""
    table = F.create_map(*(F.lit(x).cast("bigint") if isinstance(x, int) else F.lit(x) for pair in ({w: v for w, v in NUMBERS.items() if "-" not in w} | {"hundred": 100} | SCALES).items() for x in pair))
    plain = number_words(words)
    values = F.transform(F.filter(F.split(plain, " "), lambda w: w != ""), lambda w: F.try_element_at(table, w))

    def step(a: Column, v: Column) -> Column:
        above, below = v >= 1000, v < 100
        now = F.when(above, F.lit(0)).when(below, a["now"] + v).otherwise(F.greatest(a["now"], F.lit(1)) * v).cast("bigint")
        return F.struct((a["all"] + F.when(above, F.greatest(a["now"], F.lit(1)) * v).otherwise(0)).cast("bigint").alias("all"), now.alias("now"))

    zero = F.lit(0).cast("bigint")
    value = F.aggregate(values, F.struct(zero.alias("all"), zero.alias("now")), step, lambda a: a["all"] + a["now"])
    return F.when(plain.rlike(NUMBER) & (F.length(plain) > 1), value)


def in_words(n: Column) -> Column:
    """The words of a number below a million million, else null."""
    by_value = F.array(*map(F.lit, sorted(NUMBERS, key=NUMBERS.get)))
    small = lambda k: F.try_element_at(by_value, (k + 1).cast("int"))

    def group(k: Column) -> Column:
        """Of a number below a thousand; empty for zero."""
        hundreds, rest = F.floor(k / 100), k % 100
        return F.concat_ws(" ", F.when(hundreds > 0, F.concat(small(hundreds), F.lit(" hundred"))), F.when((hundreds > 0) & (rest > 0), "and"), F.when(rest > 0, small(rest)))

    parts, rest = [], n
    for name, size in SCALES.items():
        parts.append(F.when(rest >= size, F.concat(group(F.floor(rest / size)), F.lit(f" {name}"))))
        rest = rest % size
    below = F.when(rest > 0, F.when((n >= 1000) & (rest < 100), F.concat(F.lit("and "), group(rest))).otherwise(group(rest)))
    return F.when(n == 0, "zero").when((n > 0) & (n < 10**12), F.concat_ws(" ", *parts, below))


def date_of(text: Column) -> Column:
    """A date written day month year or month day, year; null where there is none such."""
    return F.coalesce(F.try_to_date(text, "d MMMM yyyy"), F.try_to_date(text, "MMMM d, yyyy"))


def written(day: Column) -> Column:
    """A date as day, month in words and year."""
    return F.concat_ws(" ", F.day(day).cast("string"), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day)), F.year(day).cast("string"))


def key_of(*parts: Column, size: int = 32) -> Column:
    """Hexadecimal digits of a digest of the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, size)


def reference(text: Column) -> Column:
    """Six upper-case hexadecimal digits that stay the same under case, punctuation and spacing."""
    norm = F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))
    return F.upper(F.substring(F.sha2(norm.cast("binary"), 256), 1, 6))


def clipped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def bare_address(value: Column) -> Column:
    """The address in a display-name form, else the value itself, in lower case."""
    inner = F.regexp_extract(value, r"<([^>]+)>", 1)
    return F.lower(F.trim(F.when(inner != "", inner).otherwise(value)))


def domain_of(address: Column) -> Column:
    return F.when(F.instr(address, "@") > 0, F.substring_index(address, "@", -1))


def stem_of(name: Column) -> Column:
    """A file name without its ending and without version marks."""
    base = F.regexp_replace(F.lower(name), r"\.[a-z0-9]+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(base, r"\((clean|draft|final|redline)\)|\bv[0-9]+\b|\b(clean|draft|final|redline|copy)\b", " "), r"[^a-z0-9]+", " "))


def roman(n: Column) -> Column:
    """Lower-case roman numerals of 1 to 3999."""
    parts = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
    steps = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in parts))
    start = F.struct(n.cast("int").alias("left"), F.lit("").alias("out"))
    step = lambda a, x: F.struct((a["left"] % x["v"]).alias("left"), F.concat(a["out"], F.repeat(x["s"], F.floor(a["left"] / x["v"]).cast("int"))).alias("out"))
    return F.aggregate(steps, start, step, lambda a: a["out"])


def letters(n: Column) -> Column:
    """a, b, ... z, aa, bb, ...: the letter repeats with each round."""
    return F.repeat(F.chr(F.lit(97) + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int"))


def compatible(text: Column) -> Column:
    """A text in Unicode's compatibility form (NFKC): ligatures, full-width letters and the like as plain ones."""
    @F.pandas_udf("string")
    def of(batch: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else unicodedata.normalize("NFKC", t) for t in batch], dtype=object)

    # Plain ASCII is its own form and stays out of Python.
    return F.when(text.rlike(r"[^\x00-\x7F]"), of(text)).otherwise(text)


def holds(text: Column, part: Column) -> Column:
    """Whether a text holds a part once both are in compatibility form, whatever their case and runs of white space; an
    empty part is held by none."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(compatible(c)), r"\s+", " "))
    return (plain(part) != "") & F.contains(plain(text), plain(part))
