"""Paraphrases of queries by fixed rules, as column expressions: how well a search holds up when a question is asked otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import text

#: Words and what stands for them, words that carry no meaning, words that begin what may move to the front.
SYNONYMS = dict(
    address="location", car="vehicle", job="position", company="employer", doctor="physician", meeting="appointment", movie="film", restaurant="diner", house="home", place="location",
    bought="purchased", buy="purchase", got="received", get="receive", told="informed", said="stated", saw="witnessed", went="traveled", like="enjoy", likes="enjoys", want="desire", wants="desires",
    big="large", small="tiny", fast="quick", good="great", bad="poor", happy="pleased",
)
DROPPED = "the a an of is do did have had has you i my that this".split()
PREPOSITIONS = "in on at from with".split()
WORD = r"[A-Za-z0-9']+"
#: What is said before a text that a rule leaves as it is.
UNSWAPPED, UNMOVED, UNDROPPED = "Specifically, ", "Regarding the topic, ", "Note: "


def _tokens(said: Column) -> Column:
    """word, rest of each word: the blanks and the one sign that may follow it; other signs are left out."""
    parts = F.regexp_extract_all(said, F.lit(rf"({WORD})(\s*\p{{Punct}}?\s*)"), F.lit(0))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, f"^{WORD}", 0).alias("word"), F.regexp_replace(x, f"^{WORD}", "").alias("rest")))


def swapped(said: Column) -> Column:
    """Known words by their synonyms, with the first letter's case."""
    known = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    named = F.transform(_tokens(said), lambda t: F.struct(t["word"].alias("word"), t["rest"].alias("rest"), F.element_at(known, text.ascii_lower(t["word"])).alias("other")))
    cased = lambda t: F.when(t["word"].rlike("^[A-Z]"), F.concat(F.upper(F.substring(t["other"], 1, 1)), t["other"].substr(F.lit(2), F.length(t["other"])))).otherwise(t["other"])
    out = F.array_join(F.transform(named, lambda t: F.concat(F.coalesce(cased(t), t["word"]), t["rest"])), "")
    return F.when(F.exists(named, lambda t: t["other"].isNotNull()), out).otherwise(F.concat(F.lit(UNSWAPPED), said))


def moved(said: Column) -> Column:
    """What the last preposition begins, if only words and commas follow it, goes to the front."""
    punct = F.regexp_extract(said, r"[.?!]\z", 0)
    body = F.substring(said, F.lit(1), F.length(said) - F.length(punct))
    found = []
    for p in [x for name in PREPOSITIONS for x in (name, name.capitalize())]:
        pattern = rf"(?s)\A(.*?)\s+({p}\s+[A-Za-z0-9\s,'\"]+)\z"
        found.append(F.when(body.rlike(pattern), F.struct(F.length(F.regexp_extract(body, pattern, 1)).alias("n"), F.regexp_extract(body, pattern, 1).alias("lead"), F.regexp_extract(body, pattern, 2).alias("part"))))
    best = F.array_max(F.filter(F.array(*found), lambda x: x.isNotNull()))
    first = lambda c: F.substring(c, 1, 1)
    rest = lambda c: c.substr(F.lit(2), F.length(c))
    out = F.concat(F.upper(first(best["part"])), rest(best["part"]), F.lit(", "), text.ascii_lower(first(best["lead"])), rest(best["lead"]), punct)
    return F.coalesce(out, F.concat(F.lit(UNMOVED), said))


def dropped(said: Column) -> Column:
    """Without words that carry no meaning."""
    tokens = _tokens(said)
    empty = lambda t: text.ascii_lower(t["word"]).isin(*DROPPED)
    left = F.array_join(F.transform(tokens, lambda t: F.concat(F.when(empty(t), "").otherwise(t["word"]), t["rest"])), "")
    left = F.regexp_replace(F.regexp_replace(left, r"\s+", " "), r"\A | \z", "")
    return F.when(F.exists(tokens, empty), left).otherwise(F.concat(F.lit(UNDROPPED), said))


RULES = (swapped, moved, dropped)


def varied(rows: DataFrame, said: str, n: int = 3) -> DataFrame:
    """rows with variants 1 to n of a text in columns <said>_1 and so on, each rule in turn applied to the one before; null stays null."""
    before = said
    for i in range(max(0, n)):
        new = f"{said}_{i + 1}"
        rows = rows.withColumn(new, RULES[i % len(RULES)](F.col(before)))
        rows = rows.withColumn(new, F.when(F.col(new) == F.col(before), F.concat(F.lit(UNSWAPPED), F.col(new))).otherwise(F.col(new)))
        before = new
    return rows
