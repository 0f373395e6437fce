"""How filters interact: what each removes at each step of every order, from one CUBE over their failure flags.

A row of the cube whose grouping set keeps some flags and the part, and whose flags are all false, counts the documents
that pass just those filters. A step of an order is a pair of such subsets, so 2^5 counts of a part give all 5! orders.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

#: The filters by letter; the last one needs the whole table.
LETTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 100, 80, 10, "[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")
ALL = (1 << len(LETTERS)) - 1


def failures(text: Column) -> dict[str, Column]:
    """The conditions that a text alone decides."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    return {"A": F.size(words) < LEAST_WORDS, "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words), "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > CAPITAL_PERCENT * F.length(text), "D": F.rlike(text, F.lit(SYMBOLS))}


def flagged(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and the failure flags that it decides, of every row; texts are read once and not shuffled."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *[x.alias(k) for k, x in failures(text).items()])


def counted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, the five flags, n, good, toxic: flagged rows, counted.

    Rows of equal texts have equal flags but for the last, so they are counted before they meet: a text is a row for each
    part and label, with its smallest doc_id and the rows that have it.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    own = ["digest", "part", *LETTERS[:-1]]
    one = rows.groupBy("doc_id", *own).agg(F.count("*").alias("n")).join(known, "doc_id", "left").na.fill(0, ["good", "toxic"])
    same = one.groupBy(*own, "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("low"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("nameless"))
    first = F.min("low.doc_id").over(Window.partitionBy("digest"))
    passing = F.coalesce("nameless", F.lit(0)) + F.when(F.col("low.doc_id") == first, F.col("low.n")).otherwise(0)
    split = same.withColumn("passing", passing).withColumn("x", F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("passing").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("passing")).alias("n")))))
    sums = [F.sum(F.col("x.n") * c).alias(k) for k, c in zip(COUNTS, (F.lit(1), F.col("good"), F.col("toxic")))]
    return split.where("x.n > 0").groupBy("part", *LETTERS[:-1], F.col("x.E").alias("E")).agg(*sums)


def survivors(cells: DataFrame) -> DataFrame:
    """part, passed (bit i: filter i of LETTERS), n, good, toxic: documents of a part that pass those filters at least; every pair, zeros too."""
    cube = cells.cube(*LETTERS, "part").agg(*[F.sum(c).alias(c) for c in COUNTS], *[F.grouping(x).alias(f"no_{x}") for x in (*LETTERS, "part")])
    passing = cube.where(reduce(lambda a, b: a & b, [(F.col(f"no_{x}") == 1) | ~F.col(x) for x in LETTERS], F.col("no_part") == 0))
    mask = reduce(lambda a, b: a + b, [(1 - F.col(f"no_{x}")).cast("int") * (1 << i) for i, x in enumerate(LETTERS)])
    every = cells.select("part").distinct().withColumn("passed", F.explode(F.sequence(F.lit(0), F.lit(ALL))))
    return every.join(passing.select("part", mask.alias("passed"), *COUNTS), ["part", "passed"], "left").na.fill(0, list(COUNTS))


def steps(spark) -> DataFrame:
    """filter_order, step, letter bit, filters before and after: a row for each step of each order, whatever the input."""
    rows = []
    for order in permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            rows.append(("".join(order), step, bit, before, before | bit))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, own int, before int, after int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts and langs are empty; texts of any length are judged whole. Rows that repeat a doc_id are documents of
    their own, none smaller than another; a null doc_id is neither smaller nor larger than any, and has no label. Of
    labels that repeat a doc_id, one that is 1 counts. An empty table gives no rows; other columns are ignored, whatever
    their names.
    """
    cells = common.staged(counted(flagged(docs), labels), "cells")
    found = common.staged(survivors(cells), "survivors")
    order = steps(docs.sparkSession)
    side = lambda name: found.select("part", F.col("passed").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in COUNTS])
    #: One more filter after each subset: its loss, and how many orders take that step.
    pairs = side("before").select("*", F.explode(F.filter(F.array(*[F.lit(1 << i) for i in range(len(LETTERS))]), lambda bit: F.col("before").bitwiseAND(bit) == 0)).alias("own"))
    pairs = pairs.withColumn("after", F.col("before") + F.col("own")).join(side("after"), ["part", "after"])
    pairs = pairs.withColumns({"removed": F.col("before_n") - F.col("after_n"), "ways": F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(LETTERS) - 1 - k)) for k in range(len(LETTERS))]), F.bit_count("before") + 1)})
    filters = pairs.groupBy("part", "own").agg(
        F.sum(F.col("removed") * F.col("ways")).alias("shapley"),
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("after") == ALL, F.col("removed"))).alias("unique_fails"),
    )
    rows = pairs.join(F.broadcast(order), ["own", "before", "after"]).join(filters, ["part", "own"])
    long = lambda c, name: c.cast("long").alias(name)
    return rows.select(
        "part", "filter_order", "step", long(F.col("after_n"), "kept"), long(F.col("removed"), "removed"), long(F.col("fails") - F.col("removed"), "redundant"), long(F.col("unique_fails"), "unique_fails"),
        long(F.col("before_good") - F.col("after_good"), "good_lost"), long(F.col("before_toxic") - F.col("after_toxic"), "toxic_lost"), long(F.col("shapley"), "shapley"),
    )
