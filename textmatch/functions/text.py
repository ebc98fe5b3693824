"""String clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Explicit classes: Java's \s and \w are ASCII, the texts are not.
WORD = r"\p{L}\p{N}_"
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS = f"[{SPACE}]"
# The same characters as a text.
SPACES = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


# A run of white space; a single blank, as most are, is no match and stays as it is. Characters below
# 256 are listed one by one, as Java looks these up in a table; one comparison rules out most others.
_NEAR = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
_FAR = rf"[\x{{1680}}-\x{{3000}}&&[{SPACE}]]"
_ANY = f"[ {_NEAR}{_FAR}]"
_RUN = f"[{_NEAR}{_FAR}]{_ANY}*+| {_ANY}++"


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, _RUN, " "))


def without(text: Column, characters: str) -> Column:
    """Delete each of a few characters; faster than to translate them."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def strip(text: Column) -> Column:
    """Remove white space, of any kind, from both ends; what is between isn't searched."""
    return F.trim(text, F.lit(SPACES))


def clean_text(text: Column) -> Column:
    """Delete quotes and exclamation marks, collapse white space; null becomes ''."""
    return F.coalesce(collapse(without(text, "'\"!")), F.lit(""))


def clean_title_text(title: Column) -> Column:
    """Collapse white space only; null becomes ''."""
    return F.coalesce(collapse(title), F.lit(""))


def first_of_list(text: Column, sep: str = ";") -> Column:
    """The trimmed text before the first separator."""
    return strip(F.substring_index(text, sep, 1))


def fingerprint(text: Column, length: int = 8) -> Column:
    """The leading hex digits of the text's MD5."""
    return F.substring(F.md5(text), 1, length)


def preview(text: Column, length: int = 200) -> Column:
    """The leading characters on one line."""
    return strip(F.translate(F.substring(text, 1, length), "\n", " "))


def ellipsis(text: Column, length: int) -> Column:
    """Cut to ``length`` characters, marking a cut with three dots."""
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))
    ).otherwise(text)


def base_name(path: Column) -> Column:
    """File name with extension."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def base_stem(path: Column) -> Column:
    """File name without its last extension; a leading dot does not start an extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def extension(path: Column) -> Column:
    """Lower-case last extension with its dot, or ''."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def hash32(text: Column) -> Column:
    """A stable unsigned 32-bit number from the text (leading MD5 digits)."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_id(title: Column, buckets: int = 10_000) -> Column:
    """Stand-in item id for a title no item resembles."""
    return F.concat(F.lit("job_"), (hash32(title) % buckets).cast("string"))


def percentage(score: Column) -> Column:
    """Score as a percentage with two places, halves up."""
    return F.floor(score * 10000 + 0.5) / 100


def round6(value: Column) -> Column:
    """Six places, halves up."""
    return F.floor(value * 1000000 + 0.5) / 1000000
