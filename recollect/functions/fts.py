"""English full-text ranking: stop words, stems, and cover density over positions.

postings() is the index: one row for each stem of a text, with its positions; it is made once, in Arrow batches, and
written. A search reads the rows of its terms only and ranks them in the JVM.

Stems follow Porter's published algorithm. Cover density is that of Clarke, Cormack and Tudhope: each shortest span that
holds all query terms adds the inverse of its length beyond the number of terms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import text

#: Function words that aren't indexed.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with "
    "about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
VOWELS = "aeiou"
WORD, SMALL_LETTERS = re.compile("[a-z0-9]+"), str.maketrans(text.UPPER, text.LOWER)


def _consonant(w: str, i: int) -> bool:
    return w[i] not in VOWELS and not (w[i] == "y" and i and _consonant(w, i - 1))


def _measure(w: str) -> int:
    """Number of runs of vowels that consonants follow."""
    shape = re.sub(r"(.)\1*", r"\1", "".join("c" if _consonant(w, i) else "v" for i in range(len(w))))
    return shape.count("vc")


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _short(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 1) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 3) and w[-1] not in "wxy"


#: Suffixes of the published algorithm's steps 2, 3 and 4, and what replaces them.
STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _suffixes(w: str, table: dict[str, str]) -> str:
    for s in sorted(table, key=len, reverse=True):
        if w.endswith(s):
            return w[: -len(s)] + table[s] if _measure(w[: -len(s)]) > 0 else w
    return w


@lru_cache(maxsize=1 << 17)
def stem(w: str) -> str:
    if len(w) < 3:
        return w
    for s, r in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(s):
            w = w[: -len(s)] + r
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (m := re.fullmatch(r"(.+)(ed|ing)", w)) and _has_vowel(m[1]):
        w = m[1]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _suffixes(_suffixes(w, STEP2), STEP3)
    for s in sorted(STEP4, key=len, reverse=True):
        if w.endswith(s):
            base = w[: -len(s)]
            w = base if _measure(base) > 1 and (s != "ion" or base.endswith(("s", "t"))) else w
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def lexemes(value: str) -> list[tuple[str, int]]:
    """Stems that are indexed, with their positions from 1; stop words take a position too."""
    return [(stem(w), i) for i, w in enumerate(WORD.findall(value.translate(SMALL_LETTERS)), 1) if w not in STOP]


def terms(query: str) -> list[str]:
    return list(dict.fromkeys(w for w, _ in lexemes(query)))


def density(value: str, wanted: list[str]) -> float:
    """0 unless all terms occur."""
    own = [(w, i) for w, i in lexemes(value) if w in wanted]
    if not wanted or {w for w, _ in own} != set(wanted):
        return 0.0
    total, last, left = 0.0, {}, 0
    for at, (w, i) in enumerate(own):
        last[w] = at
        if len(last) == len(wanted) and (start := min(last.values())) >= left:
            total += 1.0 / (i - own[start][1] + 1 - len(wanted) + 1)
            left = start + 1
    return total


def cover_density(title: Column, body: Column, query: str) -> Column:
    from pyspark.sql.functions import pandas_udf

    wanted = terms(query)

    @pandas_udf("double")
    def run(values):
        return values.map(lambda v: density(v or "", wanted)).astype("float64")

    return run(F.concat_ws(" ", title, body))


def postings(rows: DataFrame, key: str, body: Column) -> DataFrame:
    """key, lexeme, positions (ascending), words: a text's stems, and how many of its words are indexed; texts without any have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                of, names, places, words = [], [], [], []
                for i, value in enumerate(part.column(1).to_pylist()):
                    own: dict[str, list[int]] = {}
                    for w, place in lexemes(value or ""):
                        own.setdefault(w, []).append(place)
                    of += [i] * len(own)
                    words += [sum(map(len, own.values()))] * len(own)
                    names += own
                    places += own.values()
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int64())), pa.array(names, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(words, pa.int32())], [key, "lexeme", "positions", "words"])

    return rows.select(key, body.cast("string").alias("_body")).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, lexeme string, positions array<int>, words int")


def ranked(index: DataFrame, key: str, query: str) -> DataFrame:
    """key, fts_score: cover density of the texts that have all terms of a query, from the rows of these terms alone."""
    wanted = terms(query)
    own = index.where(F.col("lexeme").isin(*wanted)) if wanted else index.limit(0)
    term = F.array_position(F.array(*[F.lit(w) for w in wanted] or [F.lit("")]), F.col("lexeme")).cast("int")
    placed = F.transform("positions", lambda p: F.struct(p.alias("at"), term.alias("term")))
    by = own.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(placed))).alias("own"), F.count("*").alias("n"))
    n = max(1, len(wanted))
    start = F.struct(F.array_repeat(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("at")), n).alias("last"), F.lit(0).alias("i"), F.lit(0).alias("left"), F.lit(0.0).alias("total"))

    def step(s: Column, x: Column) -> Column:
        """Where a term's occurrence closes a shortest span that begins beyond the last one's, the span counts."""
        last = F.transform(s["last"], lambda y, k: F.when(k == x["term"] - 1, F.struct(s["i"].alias("i"), x["at"].alias("at"))).otherwise(y))
        first = F.array_min(last)
        counts = first["i"] >= s["left"]
        total = s["total"] + F.when(counts, 1.0 / (x["at"] - first["at"] + 2 - n)).otherwise(0.0)
        return F.struct(last.alias("last"), (s["i"] + 1).alias("i"), F.when(counts, first["i"] + 1).otherwise(s["left"]).alias("left"), total.alias("total"))

    return by.where(F.col("n") == n).select(key, F.aggregate("own", start, step)["total"].alias("fts_score"))
