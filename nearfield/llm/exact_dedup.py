"""Exact duplicates by deterministic block naming (DataFrame functions only).

Each normalised text is cut into blocks of a fixed number of bytes. The distinct
blocks of the corpus are sorted and get integers as names; then adjacent names are
paired, the distinct pairs are sorted and named, and so on, until each document has
one name. Two documents with as many blocks have one name just when their texts are
equal: names stand for content, not for a digest of it.

Blocks are sorted by a 64-bit key first and by content where keys tie, so content
crosses the network once, for the distinct blocks; occurrences carry the key alone.
Where two different blocks share a key (``clashes``), the occurrences of those few
blocks are named through a join on content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import ascii_lower, discard, materialize, pick

BLOCK_BYTES = 8192


def _named(distinct: DataFrame, *order: str) -> DataFrame:
    """``distinct`` with a column name: integers in the order of ``order``, fixed by
    being written. Keys are distinct, so no range is hot."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = distinct.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn("name", F.monotonically_increasing_id()))


def block_identity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, normalize: bool = True, block_bytes: int = BLOCK_BYTES, key_bits: int = 64) -> DataFrame:
    """(row, id, n_blocks, name, text_sha256), a row for each row of ``docs``: two
    rows have equal texts just when n_blocks and name are equal.

    Null texts count as empty, the empty text has one empty block, a null id is kept.
    ``row`` is a number for each row, so repeated ids are no problem. ``key_bits``
    below 64 makes keys clash, for tests.
    """
    text = ascii_lower(F.col("text")) if normalize else F.coalesce("text", F.lit(""))
    given = pick(docs, id=id_col, text=text_col).select("id", text.alias("text"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length("bytes") - 1, F.lit(0)) / block_bytes).cast("int")),
        lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)),
    )
    key = lambda b: F.shiftrightunsigned(F.xxhash64(b), 64 - key_bits) if key_bits < 64 else F.xxhash64(b)
    cut = given.withColumn("bytes", F.col("text").cast("binary"))
    rows = materialize(
        cut.select("id", F.sha2("bytes", 256).alias("text_sha256"), F.transform(blocks, key).alias("keys"))
        .select(F.monotonically_increasing_id().alias("row"), "id", "text_sha256", "keys")
    )
    distinct = cut.select(F.explode(blocks).alias("block")).select(key(F.col("block")).alias("key"), "block").distinct()
    names = _named(distinct.groupBy("key").agg(F.count("*").alias("contents")), "key")
    occ = rows.select("row", F.size("keys").alias("n_blocks"), F.posexplode("keys").alias("at", "key"))
    clashes = names.where("contents > 1")
    if clashes.isEmpty():
        level = occ.join(names.select("key", "name"), "key").select("row", "n_blocks", "at", "name")
    else:
        tied = materialize(distinct.join(clashes.select("key"), "key", "left_semi"))
        above = names.agg(F.max("name")).first()[0] + 1
        exact = _named(tied, "key", "block").select("key", "block", (F.col("name") + above).alias("name"))
        whole = materialize(cut.select(F.monotonically_increasing_id().alias("row"), "id", "bytes"))
        rows = whole.select("row", "id", F.sha2("bytes", 256).alias("text_sha256"), F.transform(blocks, key).alias("keys"))
        plain = rows.select("row", F.size("keys").alias("n_blocks"), F.posexplode("keys").alias("at", "key")).join(names.where("contents = 1"), "key")
        content = whole.select("row", F.size(blocks).alias("n_blocks"), F.posexplode(blocks).alias("at", "block")).withColumn("key", key(F.col("block")))
        content = content.join(clashes.select("key"), "key", "left_semi").join(exact, ["key", "block"])
        level = plain.select("row", "n_blocks", "at", "name").unionByName(content.select("row", "n_blocks", "at", "name"))
    level = materialize(level)
    done = level.where("n_blocks = 1").select("row", "n_blocks", "name")
    level = level.where("n_blocks > 1").withColumn("width", F.col("n_blocks"))
    while not level.isEmpty():
        pairs = level.groupBy("row", "n_blocks", F.col("width"), F.shiftright("at", 1).alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("b")
        )
        pairs = materialize(pairs.withColumn("b", F.coalesce("b", F.lit(-1))).withColumn("width", F.shiftright(F.col("width") + 1, 1)))
        names = _named(pairs.select("a", "b").distinct(), "a", "b")
        level = materialize(pairs.join(names, ["a", "b"]).select("row", "n_blocks", "at", "name", "width"))
        discard(pairs, names)
        done = done.unionByName(level.where("width = 1").select("row", "n_blocks", "name"))
        level = level.where("width > 1")
    return rows.select("row", "id", "text_sha256").join(done, "row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    Of rows with equal normalised texts the one with the largest id stays; of rows
    that tie even in the id, one of them stays; a null id is smaller than any other.
    Null texts are empty texts, and equal to each other. An empty table gives none.
    """
    named = materialize(block_identity(docs, id_col, text_col, **options))
    groups = named.groupBy("n_blocks", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("keep"))
    groups = materialize(groups)
    return named.join(groups, ["n_blocks", "name"]).select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256"
    )
