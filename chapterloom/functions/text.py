"""String functions as Catalyst expressions (no Python workers)."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, functions as F

# Java's \s is ASCII only and (?U)\s leaves out the four separators U+001C..U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    Inside a lambda every mention of an outer expression is evaluated again
    for each element; binding it to a lambda variable avoids that.
    """
    return F.get(F.transform(F.array(value), body), 0)


def filled(value: Column) -> Column:
    """The value, or null where it is empty."""
    return let(value, lambda v: F.when(v != "", v))


def strip(value: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.regexp_replace(value, rf"^{SPACE}+|{SPACE}+$", "")


def collapse(value: Column) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.btrim(F.regexp_replace(value, rf"{SPACE}+", " "))


def is_blank(value: Column) -> Column:
    return value.rlike(rf"^{SPACE}*$")


def shorten(value: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, trim the end and add an ellipsis."""
    cut = F.regexp_replace(F.substring(value, 1, limit), rf"{SPACE}+$", "")
    return F.when(F.char_length(value) > limit, F.concat(cut, F.lit("…"))).otherwise(value)


def escape_markup(value: Column) -> Column:
    """``& < > "`` as entities, ampersand first."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(raw), F.lit(entity))
    return value


# Letters without a decomposition that must survive in a slug.
LETTERS_ONE = {"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D"}
LETTERS_MANY = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th"}


@functools.cache
def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility form has ASCII in it, by length of that part."""
    one, many = {}, {}
    for point in range(0x80, 0x20000):
        if 0xD800 <= point < 0xE000:
            continue
        char = chr(point)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one[char] = plain
        elif plain:
            many[char] = plain
    return one, many


def ascii_fold(value: Column) -> Column:
    """ASCII part of the compatibility decomposition; other characters vanish."""
    plain_already = ~value.rlike(r"[^\x00-\x7F]")
    return F.when(plain_already, value).otherwise(_folded(value))


def _folded(value: Column) -> Column:
    one, many = _decompositions()
    for raw, plain in LETTERS_MANY.items():
        value = F.replace(value, F.lit(raw), F.lit(plain))
    single = {**one, **LETTERS_ONE}
    value = F.translate(value, "".join(single), "".join(single.values()))
    # One literal that folds into a map, instead of hundreds of expressions.
    listed = F.lit("\x01".join(f"{c}\x02{p}" for c, p in many.items()))
    pairs = F.map_entries(F.str_to_map(listed, F.lit("\x01"), F.lit("\x02")))

    def expand(text: Column) -> Column:
        longer = F.aggregate(pairs, text, lambda acc, x: F.replace(acc, x["key"], x["value"]))
        # A hashed deletion tells cheaply whether any of the longer ones occurs.
        return F.when(F.translate(text, "".join(many), "") != text, longer).otherwise(text)

    return F.regexp_replace(let(value, expand), r"[^\x00-\x7F]", "")


_SEPARATORS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def slugify(value: Column, fallback: str = "novel", max_length: int = 80) -> Column:
    """A file name safe on every system: lower-case ASCII words joined by dashes."""
    # Single dashes come from a table; the pattern is left with the rare longer runs.
    dashed = F.translate(ascii_fold(value), _SEPARATORS, "-" * len(_SEPARATORS))
    words = F.btrim(F.regexp_replace(dashed, "--+", "-"), F.lit("-"))
    cut = F.rtrim(F.substring(F.lower(words), 1, max_length), F.lit("-"))
    return F.coalesce(filled(cut), F.lit(fallback))
