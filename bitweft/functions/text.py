"""Text functions on columns: symbols, character classes, tokenizers, positions, escapes and costs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for the sentinel in plans on characters: more than one character, so no symbol of a text can equal it.
SENTINEL = "<end>"
#: The sentinel's number in plans on integer symbols (fixed value of the file formats).
SENTINEL_SYMBOL = 2147483646

#: Character classes by their ASCII members (fixed values).
CLASSES = {
    "ascii": r"[\x00-\x7F]", "vowel": "[AEIOUaeiou]", "consonant": "[B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]", "alphanumeric": "[A-Za-z0-9]", "alpha": "[A-Za-z]",
    "control": r"[\x00-\x1F\x7F]", "digit": "[0-9]", "graph": r"[\x21-\x7E]", "lower": "[a-z]", "print": r"[\x20-\x7E]", "punct": r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", "space": r"[\x09-\x0D\x20]", "upper": "[A-Z]",
}


def chars(text: Column) -> Column:
    """The characters of a text, in order; none for the empty text."""
    return F.when(F.char_length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, "", -1))


def symbols(text: Column, sentinel: bool = True) -> Column:
    """Code points, with one trailing sentinel as documents are loaded."""
    codes = F.transform(F.filter(chars(text), lambda c: c != ""), F.ascii)
    return F.concat(codes, F.array(F.lit(SENTINEL_SYMBOL))) if sentinel else codes


def count_class(text: Column, name: str) -> Column:
    return F.regexp_count(text, F.lit(CLASSES[name])).cast("long")


def count_classes(text: Column) -> Column:
    """A struct of the counts of all CLASSES: one pass gives each ASCII character a letter for the set of classes it is
    in, then each letter is counted by the length that the text loses without it."""
    sets: dict[tuple[str, ...], list[str]] = {}
    for c in map(chr, range(128)):
        sets.setdefault(tuple(n for n, p in CLASSES.items() if re.match(p, c)), []).append(c)
    letters = dict(zip(sets, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", strict=False))
    to = {c: letters[k] for k, members in sets.items() for c in members}
    coded = F.array(F.translate(text, "".join(to), "".join(to.values())))
    of = lambda t, x: (F.char_length(t) - F.char_length(F.replace(t, F.lit(x), F.lit("")))).cast("long")
    each = F.transform(coded, lambda t: F.struct(*[of(t, x).alias(x) for x in letters.values()]))
    return F.transform(each, lambda r: F.struct(*[sum((r[x] for k, x in letters.items() if n in k), F.lit(0).cast("long")).alias(n) for n in CLASSES]))[0]


def escape(text: Column) -> Column:
    r"""Escaped form: a backslash is doubled, every other character outside printable ASCII becomes \number\."""
    one = lambda c: F.when(c == "\\", "\\\\").when(c.rlike(r"^[\x20-\x7E\n\t]$"), c).otherwise(F.concat(F.lit("\\"), F.ascii(c).cast("string"), F.lit("\\")))
    return F.array_join(F.transform(chars(text), one), "")


def unescape(text: Column) -> Column:
    r"""The characters of an escaped text: \\ is a backslash, \number\ a symbol."""
    part = F.regexp_extract_all(text, F.lit(r"(?s)(\\[0-9]*\\|.)"), F.lit(1))
    one = lambda p: F.when(p == "\\\\", "\\").when(p.rlike(r"^\\[0-9]+\\$"), F.decode(F.unhex(F.lpad(F.hex(F.regexp_extract(p, "([0-9]+)", 1).cast("int")), 8, "0")), "UTF-32")).otherwise(p)
    return F.array_join(F.transform(part, one), "")


def nonword_words(text: Column) -> Column:
    """(nonword, word) pairs: a maximal run of other characters, then a maximal run of letters and digits."""
    pair = F.regexp_extract_all(text, F.lit("([^A-Za-z0-9]*[A-Za-z0-9]+|[^A-Za-z0-9]+$)"), F.lit(1))
    return F.transform(pair, lambda p: F.struct(F.regexp_extract(p, "^([^A-Za-z0-9]*)", 1).alias("nonword"), F.regexp_extract(p, "([A-Za-z0-9]*)$", 1).alias("word")))


def words(text: Column) -> Column:
    """Words between runs of ASCII white space."""
    return F.filter(F.split(text, r"[\x09-\x0D\x20]+", -1), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """Words after removing all but letters, digits, underscore and white space of ASCII."""
    return words(F.regexp_replace(text, r"[^A-Za-z0-9_\x09-\x0D\x20]", ""))


def to_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def drop_last_eoln(text: Column) -> Column:
    """The text without a line feed at its end (one, if there are several)."""
    return F.regexp_replace(text, r"\n\z", "")


def drop_eolns(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(""))


def range_bits(low: Column, high: Column, total: Column) -> Column:
    """Cost of a coding range; the whole range costs nothing."""
    return F.when((low == 0) & (high == total), F.lit(0.0)).otherwise(-F.log2((high - low) / total))


def sss_bits(symbol: Column, start: int = 0, step: int = 2, stop: int = 32) -> Column:
    """Length in bits of the start-step-stop code of a non-negative integer (null beyond the code)."""
    out, base, n = F.lit(None).cast("int"), 0, 0
    rows = []
    for width in range(start, stop + 1, step):
        rows.append((base, base + (1 << width), n + (1 if width + step <= stop else 0) + width))
        base, n = base + (1 << width), n + 1
    for low, high, bits in reversed(rows):
        out = F.when((symbol >= F.lit(low)) & (symbol < F.lit(high)), F.lit(bits)).otherwise(out)
    return out


def sss_code(symbol: Column, start: int = 0, step: int = 2, stop: int = 32) -> Column:
    """The start-step-stop code itself, as a string of bits: a unary prefix, then the field."""
    out, base, n = F.lit(None).cast("string"), 0, 0
    rows = []
    for width in range(start, stop + 1, step):
        last = width + step > stop
        rows.append((base, base + (1 << width), "1" * n + ("" if last else "0"), width))
        base, n = base + (1 << width), n + 1
    for low, high, prefix, width in reversed(rows):
        field = F.lpad(F.bin((symbol - F.lit(low)).cast("long")), width, "0") if width else F.lit("")
        out = F.when((symbol >= F.lit(low)) & (symbol < F.lit(high)), F.concat(F.lit(prefix), field)).otherwise(out)
    return out
