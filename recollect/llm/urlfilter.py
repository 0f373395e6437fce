"""URL rules by a cascade of Bloom filters, in DataFrame expressions only.

The key universe of a corpus is every (host suffix, path prefix) that one of its urls has. Level 1 encodes the listed
keys, level 2 the universe's other keys that level 1 lets through, level 3 the listed keys that level 2 lets through,
and so on until a level lets nothing wrong through. A key is listed if the first level that refuses it is an even one,
or if the last level that takes it is an odd one: exact for the whole universe, and without a join. Filters too long
for constants of a plan are cut into buckets, and a key is joined with its bucket's filters, not with listed keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import common

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY, HASHES, LEAST_BITS = 16, 4, 512
#: Most bits of any level in a plan (512 KB); where one would have more, the cascade is cut into buckets of keys.
MOST_BITS = 1 << 22
#: Listed keys of a bucket on average, and copies of its filters, over which the urls that have a frequent key are dealt.
BUCKET_KEYS, COPIES = 4096, 16


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, path_lengths: list[int], most_labels: int) -> Column:
    """Every suffix of the host of at most most_labels labels with every prefix of the path that is as long as some rule's."""
    own = F.split(host, r"\.", -1)
    labels = F.slice(own, F.greatest(F.lit(1), F.size(own) - most_labels + 1), F.lit(most_labels))
    lengths = F.array(*[F.lit(n) for n in path_lengths])
    fitting = F.filter(lengths, lambda n: n <= F.length(path))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.struct(s.alias("host"), F.substring(path, F.lit(1), n).alias("path")))))


#: Between a key's host and path; neither of a url can hold it.
MARK = "?"


def key_text(key: Column) -> Column:
    return F.concat(key["host"], F.lit(MARK), key["path"])


def rule_text(key: Column) -> Column:
    """A key as the rule is written: each part may hold a mark only in rules that fit no url."""
    return F.concat(F.substring_index(key, MARK, 1), F.substring(key, F.length(F.substring_index(key, MARK, 1)) + 2, F.length(key)))


def positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def bits_for(n: int) -> int:
    return max(LEAST_BITS, 1 << (n * BITS_PER_KEY - 1).bit_length())


def all_set(words: Column, key: Column, level: int, bits: int) -> Column:
    one = lambda at: F.getbit(F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1
    return reduce(lambda a, b: a & b, [one(at) for at in positions(key, level, bits)])


def listed_by(takes: list[Column]) -> Column:
    """Whether a key of the universe is listed, by what each level of its cascade takes."""
    found = F.lit(len(takes) % 2 == 1)
    for i in range(len(takes) - 1, -1, -1):
        found = F.when(takes[i], found).otherwise(F.lit(i % 2 == 1))
    return found


class Level:
    """One Bloom filter as a constant of the plan; bits is a power of two, at most most_bits."""

    def __init__(self, keys: DataFrame, n: int, level: int):
        self.level, self.bits = level, bits_for(n)
        at = keys.select(F.explode(F.array(*positions(F.col("key"), level, self.bits))).alias("at"))
        words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).collect()
        held = dict.fromkeys(range(self.bits // 64), 0) | {x["word"]: x["bits"] for x in words}
        self.words = ",".join(str(held[i]) for i in range(self.bits // 64))

    def takes(self, key: Column) -> Column:
        return all_set(F.split(F.lit(self.words), ",").cast("array<bigint>"), key, self.level, self.bits)


class Cascade:
    """Exact membership of the keys of a universe in a list."""

    def __init__(self, listed: DataFrame, n: int, first: Level | None = None):
        self.listed, self.levels = listed, [first or Level(listed, n, 1)] if n else []

    def add_levels(self, suspects: DataFrame, most_bits: int | None = None) -> "Cascade | None":
        """suspects: the universe's keys that level 1 takes, and perhaps others; None if a level would have over most_bits."""
        if not self.levels:
            return self
        most_bits = most_bits or MOST_BITS
        inside = self.listed
        outside = suspects.where(self.levels[0].takes(F.col("key"))).join(self.listed, "key", "left_anti")
        while n := outside.count():
            if n * BITS_PER_KEY > most_bits:
                return None
            self.levels.append(Level(outside, n, len(self.levels) + 1))
            inside, outside = outside, inside.where(self.levels[-1].takes(F.col("key")))
        return self

    def has(self, key: Column) -> Column:
        return listed_by([x.takes(key) for x in self.levels])


class Buckets:
    """The cascades of long lists, cut by a hash of the key: each bucket has small filters of its own, all in one row.

    A level has as many bits in one bucket as in another. A key meets the row of its bucket, never the listed keys;
    which keys a list has is decided by the levels alone, as in Cascade.
    """

    def __init__(self, listed: DataFrame, sizes: dict[str, int]):
        """listed: key, action; sizes: how many keys each action has."""
        self.n = 1 << max(0, -(-max(sizes.values()) // BUCKET_KEYS) - 1).bit_length()
        self.levels = {x: [] for x in sizes}
        self.tables: dict[str, DataFrame] = {}
        self.listed = {x: listed.where(F.col("action") == x).select(self.bucket(F.col("key")).alias("bucket"), "key") for x in sizes}
        for action, n in sizes.items():
            self._add(action, self.listed[action], n)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(self.n))

    def _add(self, action: str, keys: DataFrame, n: int) -> None:
        level, bits = len(self.levels[action]) + 1, bits_for(-(-n // self.n))
        own = keys.select("bucket", F.explode(F.array(*positions(F.col("key"), level, bits))).alias("at"))
        own = own.select("bucket", F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bits"))
        empty = keys.sparkSession.range(self.n * (bits // 64)).select(F.expr(f"id div {bits // 64}").alias("bucket"), F.expr(f"id % {bits // 64}").alias("word"), F.lit(0).cast("long").alias("bits"))
        words = own.unionByName(empty).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
        words = words.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("words"))
        self.levels[action].append(bits)
        self.tables[f"{action}{level}"] = common.staged(words, "filters")

    def _taken(self, action: str, keys: DataFrame, level: int) -> DataFrame:
        """The keys that a level takes; keys are distinct, so buckets are even."""
        found = keys.join(self.tables[f"{action}{level}"], "bucket")
        return found.where(all_set(F.col("words"), F.col("key"), level, self.levels[action][level - 1])).select("bucket", "key")

    def add_levels(self, universe: DataFrame) -> None:
        """universe: the distinct keys of the urls."""
        keys = universe.select(self.bucket(F.col("key")).alias("bucket"), "key")
        for action, inside in self.listed.items():
            outside = common.staged(self._taken(action, keys, 1).join(inside.select("key"), "key", "left_anti").select("bucket", "key"), "suspects")
            while n := outside.count():
                self._add(action, outside, n)
                inside, outside = outside, common.staged(self._taken(action, inside, len(self.levels[action])), "suspects")

    def filters(self) -> DataFrame:
        """One row for each bucket and copy, with a column of words for each level of each action."""
        rows = reduce(DataFrame.unionByName, [x.withColumn("name", F.lit(name)) for name, x in self.tables.items()])
        rows = rows.groupBy("bucket").pivot("name", list(self.tables)).agg(F.first("words"))
        return common.staged(rows, "filters").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))

    def has(self, action: str, key: Column) -> Column:
        return listed_by([all_set(F.col(f"{action}{i + 1}"), key, i + 1, bits) for i, bits in enumerate(self.levels.get(action, []))])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    rules: host, path, action (allow or block). A rule fits its host and the host's subdomains where the path starts
    with the rule's; the longest text wins, then the longer host; a rule listed with both actions blocks. Urls that are
    null or lack "://" have an empty host and path; urls may be of any length. Without a fitting rule, the url is in no list, and the verdict is
    default. Rules that are null or repeat add nothing. Other columns are ignored; an empty table gives no rows.
    """
    rules = common.staged(rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("action").alias("action")).withColumn("key", F.concat("host", F.lit(MARK), "path")), "rules")
    sizes = {x["action"]: x["n"] for x in rules.groupBy("action").agg(F.count("*").alias("n")).collect()}
    lengths = sorted(x[0] for x in rules.select(F.length("path")).distinct().collect())
    labels = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0]  # no longer suffix can be a rule's host
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not lengths:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if max(sizes.values()) * BITS_PER_KEY > most_bits:
        return _by_buckets(urls, rules, sizes, lengths, labels, default)
    cascades = {x: Cascade(rules.where(F.col("action") == x).select("key"), sizes.get(x, 0)) for x in ("allow", "block")}
    keys = F.transform(keys_of(F.col("host"), F.col("path"), lengths, labels), key_text)
    taken = [c.levels[0] for c in cascades.values() if c.levels]
    suspects = urls.select(F.explode(F.array_distinct(F.filter(keys, lambda k: reduce(lambda a, b: a | b, [x.takes(k) for x in taken])))).alias("key")).distinct()
    suspects = common.staged(suspects, "suspects")
    if not all([c.add_levels(suspects, most_bits) for c in cascades.values()]):
        return _by_buckets(urls, rules, sizes, lengths, labels, default)
    judged = F.transform(
        keys_of(F.col("host"), F.col("path"), lengths, labels),
        lambda k: F.struct(F.length(key_text(k)).alias("length"), F.length(k["host"]).alias("host_length"), key_text(k).alias("key"), F.when(cascades["block"].has(key_text(k)), "block").when(cascades["allow"].has(key_text(k)), "allow").alias("action")),
    )
    best = F.array_max(F.filter(judged, lambda x: x["action"].isNotNull()))
    return urls.withColumn("best", best).select("page_id", "host", "path", rule_text(F.col("best.key")).alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def _by_buckets(urls: DataFrame, rules: DataFrame, sizes: dict[str, int], lengths: list[int], labels: int, default: str) -> DataFrame:
    """For lists too long for a plan: the keys of the distinct (host, path) meet the filters of their buckets."""
    buckets = Buckets(rules.select("key", "action"), sizes)
    own = urls.select("host", "path").distinct()
    keys = F.transform(keys_of(F.col("host"), F.col("path"), lengths, labels), lambda k: F.struct(F.length(key_text(k)).alias("length"), F.length(k["host"]).alias("host_length"), key_text(k).alias("key")))
    pairs = own.select("host", "path", F.explode(keys).alias("k"))
    buckets.add_levels(common.staged(pairs.select("k.key").distinct(), "universe"))
    pairs = pairs.withColumns({"bucket": buckets.bucket(F.col("k.key")), "copy": F.pmod(F.xxhash64("host", "path"), F.lit(COPIES)).cast("int")})
    judged = pairs.join(buckets.filters(), ["bucket", "copy"])
    key = F.col("k.key")
    judged = judged.select("host", "path", "k", F.when(buckets.has("block", key), "block").when(buckets.has("allow", key), "allow").alias("action")).where("action is not null")
    best = judged.groupBy("host", "path").agg(F.max(F.struct("k.length", "k.host_length", "k.key", "action")).alias("best"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", rule_text(F.col("best.key")).alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
