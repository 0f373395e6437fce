"""Fill-in-the-middle by escaped marker injection, in DataFrame expressions.

A control character is escaped in the text and then appended to every unit by regexp_replace. Counting it gives the
number of units, substring_index cuts at a unit's rank, and the parts are unescaped and put together. A text that holds
a sentinel, and a share of all others, stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The sentinels of prefix, suffix and middle, and a unit.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINES = r"[^\n]*\n|[^\n]+"
SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
#: Ends a unit, and stands before what replaces either of the two in a text.
MARK, ESCAPE = "\x01", "\x02"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(MARK), F.lit(ESCAPE + "m"))


def unescape(text: Column) -> Column:
    """Marks that ended units go; escaped ones come back."""
    bare = F.replace(text, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "m"), F.lit(MARK)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def marked(text: Column, unit: str = LINES) -> Column:
    """The escaped text with a mark after each unit; unit may match neither the mark nor between an escape and what follows it."""
    return F.regexp_replace(escape(text), f"({unit})", f"$1{MARK}")


def first(marked_text: Column, n: Column) -> Column:
    return F.call_function("substring_index", marked_text, F.lit(MARK), n.cast("int"))


def last(marked_text: Column, n: Column) -> Column:
    """The last n units of a text that ends without a mark, or of one with it where n counts what follows that mark."""
    return F.call_function("substring_index", marked_text, F.lit(MARK), -n.cast("int"))


def draw(doc_id: Column, seed: int, which: int) -> Column:
    """The 8 hex digits at place which of the sha256 of seed:doc_id, as a number; a null doc_id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * which - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, unit: str = LINES) -> DataFrame:
    """doc_id, n, form, prefix, middle, suffix, output of every row.

    The prefix ends after the smaller of two drawn counts of units, the middle after the larger. form is plain, psm or
    spm; parts are null where it is plain. unit's matches must cover a text. Null texts are empty, and empty ones plain
    with n 0; texts of any length are taken whole, a text without a line feed is one unit. Draws depend on doc_id alone,
    so repeated rows come out alike, and rows of a null doc_id share one draw. An empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("units", marked(F.col("text"), unit))
    n = F.length("units") - F.length(F.replace(F.col("units"), F.lit(MARK), F.lit("")))
    rows = rows.withColumn("n", n.cast("long")).withColumns({f"h{i}": draw(F.col("doc_id"), seed, i) for i in range(1, 5)})
    plain = (F.col("text") == "") | F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE)) | (F.col("h3") % 100 >= fim_percent)
    rows = rows.withColumns({"a": F.least(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)), "b": F.greatest(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)), "form": F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")})
    fim = lambda part: F.when(F.col("form") != "plain", unescape(part))
    rows = rows.withColumns(
        {
            "prefix": fim(first(F.col("units"), F.col("a"))),
            "middle": fim(last(first(F.col("units"), F.col("b")), F.col("b") - F.col("a"))),
            "suffix": fim(last(F.col("units"), F.col("n") - F.col("b") + 1)),
        }
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    middle = F.substring_index(output, MIDDLE, -1)
    ahead = F.substring_index(output, MIDDLE, 1)
    inner, outer = (lambda mark: F.substring_index(ahead, mark, -1)), (lambda mark: F.replace(F.substring_index(ahead, mark, 1), F.lit(PREFIX if mark == SUFFIX else SUFFIX), F.lit("")))
    psm = F.concat(outer(SUFFIX), middle, inner(SUFFIX))
    spm = F.concat(inner(PREFIX), middle, outer(PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(rows: DataFrame) -> DataFrame:
    """Counts and digests of transformed rows; null where a part is null."""
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    return rows.select("doc_id", "n", "form", chars("prefix"), chars("middle"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
