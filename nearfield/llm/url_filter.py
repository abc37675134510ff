"""Exact URL filtering by a Bloom filter cascade (DataFrame functions only).

Level 1 encodes the listed keys. Of the other keys of the corpus some pass it all the
same; level 2 encodes those, level 3 the listed keys that pass level 2, and so on
until nothing passes that should not. As the levels are built over the complete
universe of the corpus's keys, the first level that a key misses decides its
membership exactly, and no table of keys is joined with the pages.

Each level is an array of 64-bit words that is built by a grouped bit_or and used as
a scalar subquery. Its size follows the list, not the corpus: the share of false
positives of level 1 is chosen so that about as many keys enter level 2 as level 1
has. ``max_bits`` bounds a level: a longer list is cut by the hash of its keys into
shards with a cascade each, and the pages' keys are looked up shard by shard, so that no
task ever holds more than one shard's levels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import LOWER, UPPER, discard, materialize

#: Production parameters: bits of a level at most (32 MB), and the bits of a key that
#: levels after the first test.
MAX_BITS, LATER_HASHES = 1 << 28, 4
#: The rules of the production query, host and path together.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path without query and fragment; both are
    empty for null and for urls without ``://``."""
    at = F.position(F.lit("://"), url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null: none) and its verdict. The rules are part of
    the expression, so they should be few (thousands at most)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _positions(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    h = F.xxhash64(key, F.lit(level))
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("long"))
    return [(low + high * i) % bits for i in range(hashes)]


def bits_of_first(inside: int, outside: int) -> tuple[int, int]:
    """(hashes, bits) of the first level for so many listed and other keys."""
    hashes = max(1, math.ceil(math.log2(max(2.0, math.sqrt(2) * outside / max(1, inside)))))
    return hashes, _bits(inside, hashes)


def _bits(n: int, hashes: int) -> int:
    return max(64, math.ceil(n * hashes / math.log(2) / 64) * 64)


class Cascade:
    """The levels for ``keys`` (key, listed): distinct keys, a written table."""

    def __init__(self, keys: DataFrame):
        counts = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}
        hashes, bits = bits_of_first(counts.get(True, 0), counts.get(False, 0))
        self.levels: list[tuple[int, int, DataFrame]] = []
        n, encoded, rest = counts.get(True, 0), keys.where("listed"), keys.where("not listed")
        while n:
            self.levels.append((hashes, bits, self._words(encoded, len(self.levels) + 1, hashes, bits)))
            passing = materialize(rest.where(self._hit(F.col("key"), len(self.levels))))
            encoded, rest, n, hashes = passing, encoded, passing.count(), LATER_HASHES
            bits = _bits(n, hashes)

    @classmethod
    def of(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """The cascade for ``listed`` over ``universe`` (one column key each)."""
        return cls(marked(listed, universe))

    @staticmethod
    def _words(keys: DataFrame, level: int, hashes: int, bits: int) -> DataFrame:
        at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, hashes, bits))).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("word"))
        every = keys.sparkSession.range(bits // 64).join(words, "id", "left")
        # bits // 64 words at most, whose number max_bits bounds
        packed = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word")))).alias("w"))
        return materialize(packed.select(F.col("w.word").alias("words")))

    def _hit(self, key: Column, level: int) -> Column:
        hashes, bits, table = self.levels[level - 1]
        words, hit = table.scalar(), F.lit(True)
        for at in _positions(key, level, hashes, bits):
            bit = F.call_function("shiftrightunsigned", F.get(words, F.shiftright(at, 6).cast("int")), (at % 64).cast("int"))
            hit = hit & (bit.bitwiseAND(F.lit(1).cast("long")) == 1)
        return hit

    def is_listed(self, key: Column) -> Column:
        """Exact for every key of the universe and of the list; null is not listed."""
        found = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels), 0, -1):
            found = F.when(self._hit(key, level), found).otherwise(F.lit(level % 2 == 0))
        return F.coalesce(found & key.isNotNull(), F.lit(False))


def marked(listed: DataFrame, universe: DataFrame) -> DataFrame:
    """(key, listed), the distinct keys of both, as a written table."""
    keys = universe.select("key").withColumn("listed", F.lit(False)).union(listed.select("key").withColumn("listed", F.lit(True)))
    return materialize(keys.where("key is not null").groupBy("key").agg(F.max("listed").alias("listed")))


def with_listed(rows: DataFrame, keys: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` with a boolean ``listed`` for their column key; ``keys`` (see marked)
    has all of those."""
    counts = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    need = bits_of_first(counts.get(True, 0), counts.get(False, 0))[1]
    if need <= max_bits:
        return rows.withColumn("listed", Cascade(keys).is_listed(F.col("key")))
    shards = math.ceil(1.25 * need / max_bits)  # they do not come out all alike
    shard = F.pmod(F.xxhash64(F.lit("shard"), "key"), F.lit(shards)).cast("int").alias("_shard")
    by_shard = lambda d: materialize(d.select("*", shard), "_shard")
    keys, rows = by_shard(keys), by_shard(rows)
    looked_up = []
    for s in range(shards):
        mine = Cascade(keys.where(F.col("_shard") == s).drop("_shard"))
        looked_up.append(materialize(rows.where(F.col("_shard") == s).drop("_shard").withColumn("listed", mine.is_listed(F.col("key")))))
    discard(keys, rows)
    out = looked_up[0]
    for more in looked_up[1:]:
        out = out.unionByName(more)
    return out


def filter_urls(pages: DataFrame, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", *, rules=RULES, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, host, path, rule, verdict), a row for each row of ``pages``: the verdict
    of the longest rule that fits, else block for keys (host and path together) of
    ``listed`` (a column key) and allow for others.

    A null url, or one without ``://``, has an empty host and path and no rule. Without
    ``listed``, ``sample_list`` of the corpus stands in for a block list. Repeated
    rows and null ids are kept; an empty table gives no rows.
    """
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias(id_col), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("key", F.concat("host", "path"))
    universe = rows.select("key").distinct()
    if listed is None:
        universe = materialize(universe)
        listed = sample_list(universe)
    rows = with_listed(rows, marked(listed, universe), max_bits)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return rows.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))


def sample_list(universe: DataFrame) -> DataFrame:
    """A stand-in for a block list: every key whose md5 begins with 0."""
    return universe.where(F.substring(F.md5("key"), 1, 1) == "0").select("key")
