"""Text expressions. Lower-casing and word characters are ASCII; other characters separate words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ELLIPSIS = "…"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column, least: int = 1) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"[a-z0-9]{{{least},}}"), 0)


def rerank_tokens(text: Column) -> Column:
    """Distinct runs of at least two ASCII letters, digits and underscores, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(ascii_lower(text), F.lit("[a-z0-9_]{2,}"), 0))


def clip(text: Column, most: int) -> Column:
    """At most so many characters, with an ellipsis where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(ELLIPSIS))).otherwise(text)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def djb2(text: Column, modulus: int) -> Column:
    """h = 33 h + byte from 5381, over UTF-8 bytes, reduced at each step."""
    letters = F.filter(F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(5381).cast("long"), lambda h, c: F.pmod(h * 33 + F.ascii(c), F.lit(modulus)))


def djb2_hex(text: Column) -> Column:
    return F.lower(F.lpad(F.hex(djb2(text, 1 << 32)), 8, "0"))


def source_checksum(text: Column) -> Column:
    """Of the text with CRLF and CR as LF, so that line endings don't count as edits."""
    return djb2_hex(F.regexp_replace(text, "\r\n?", "\n"))


def sentences(text: Column) -> Column:
    """Trimmed, lower-cased sentences: cut at white space after a full stop, exclamation or question mark."""
    parts = F.transform(F.split(ascii_lower(text), r"(?<=[.!?])\s"), trimmed)
    return F.filter(parts, lambda s: s != "")


def shared_words(a: Column, b: Column, least: int = 4) -> Column:
    """Distinct words of at least so many letters that both texts have."""
    return F.size(F.array_intersect(words(a, least), words(b, least)))


def has_all(tokens: Column, terms: list[str]) -> Column:
    """Whether each term is among the tokens; never for no terms."""
    return reduce(lambda x, y: x & y, [F.array_contains(tokens, t) for t in dict.fromkeys(terms)]) if terms else F.lit(False)


def occurrences(text: Column, term: str) -> Column:
    """How often a word (of ASCII letters and digits, small) occurs, whatever the case of the text's ASCII letters; the text isn't copied."""
    letters = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in term)
    return F.regexp_count(text, F.lit(f"{letters}(?![A-Za-z0-9])(?<![A-Za-z0-9]{'.' * len(term)})"))


def counts_of(text: Column, terms: list[str]) -> Column:
    """An array of the occurrences of each distinct term."""
    return F.array(*[occurrences(text, t) for t in dict.fromkeys(terms)])


def occurrence_rank(counts: Column) -> Column:
    """Lexical rank without positions: the sum of ln(1 + occurrences) where all terms occur, else 0, as for no terms.

    Rounded, so that equal counts tie whatever the order of summation. counts is a column that holds counts_of(), so that
    a text is read once for each term.
    """
    total = F.aggregate(counts, F.lit(0.0), lambda s, n: s + F.log1p(n.cast("double")))
    return F.when(F.exists(counts, lambda n: n == 0), 0.0).otherwise(F.coalesce(F.round(total, 12), F.lit(0.0)))


def repaired(raw: Column) -> Column:
    """A binary column as text, with a space for each run of bytes that isn't UTF-8."""
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("\ufffd"), F.lit(" "))


def approx_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def path_module(path: Column) -> Column:
    """a/b/init.lua and a/b.lua are a.b."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.[A-Za-z0-9_]+$", ""), r"/(init|index|__init__)$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^\./", ""), "/", ".")


def path_words(path: Column) -> Column:
    bare = F.regexp_replace(path, r"\.[A-Za-z0-9_]+$", "")
    return F.trim(F.regexp_replace(bare, r"[/\\.\-_\s]+", " "))
