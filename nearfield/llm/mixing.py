"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, gone through up to
``repeats`` times. A document's virtual finish time is the sum of sizes of its queue
up to its end, divided by the target of its source. The documents of all queues are
ordered by finish time, and the order is cut where the total budget is used up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from nearfield.llm.common import materialize, pick, running_sum, word_count

#: The production parameters.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, source_rank, target) from (source, source_size), a row
    for each source: the sources, by code point and null last, have the weights in
    turn and share ``share`` of all sizes. No target is above ``repeats`` times its
    source's size; what is above goes to the others by weight. Sources are filled in
    the order of that limit by weight, so that one pass finds the level at which the
    rest share. It sorts a row for each source, not the corpus."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("source_rank", F.row_number().over(by_name).cast("long"))
    t = t.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * float(repeats))
    order = Window.orderBy(F.col("cap") / F.col("w"), "source_rank")
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("total", F.sum("source_size").over(every) * float(share))
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("w").over(later))
    # the first source in that order that stays below its limit gives the level
    opens = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.row_number().over(order).alias("at"), "level"))
    t = t.withColumn("opens", opens).withColumn("fill", F.min("opens").over(every)["level"])
    goal = F.when(F.col("fill").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("fill") * F.col("w")))
    return t.select("source", "source_size", "source_rank", goal.alias("target"))


def _stretch(finish: Column) -> Column:
    """A growing function of the finish time: even near the cut, slow far beyond it."""
    return F.when(finish <= 1.5, finish).otherwise(1.5 + F.log(finish / 1.5))


def _literal(value, kind: DataType) -> Column:
    if isinstance(kind, StructType) and value is not None:
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind])
    return F.lit(value).cast(kind)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, row_col: str | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(id, source, size, source_size, target, passes, taken), a row for each row of
    ``docs``: the mix takes the document ``passes`` times, ``taken`` = size * passes.

    A document's size is its number of words (null: 0). The shuffle is the order of
    md5(id), then id and size, so reruns agree; rows that tie in all three take turns.
    Null sources are a source of their own. Documents without words, and with them
    an empty corpus, are never taken. A hot source is cut by digest into buckets.
    ``row_col`` names a column with another value for each row, a struct perhaps; the
    result has it too, so that rows which share an id, or have none, can be told apart.
    """
    given = pick(docs, id=id_col, source=source_col, text=text_col, **({"row": row_col} if row_col else {}))
    row = F.col("row") if row_col else F.monotonically_increasing_id()
    sized = given.select("id", "source", word_count(F.col("text")).alias("size"), row.alias("row"))
    sized = materialize(sized.withColumn("key", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))))
    pieces = max(4096, math.isqrt(sized.count()))  # of a unit of finish time
    goals = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats))
    budget = (goals.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    queue = running_sum(sized, "source", "key", ["id", "size", "row"], "size", "upto")
    queue = queue.join(goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    queue = materialize(queue.select("id", "row", "key", "source", "size", "source_size", "target", "source_rank", "upto"))
    each = queue.where("size > 0 and target > 0").select("row", "key", "id", "size", "source_rank", F.explode(F.array(*[F.lit(i) for i in range(repeats)])).alias("pass"), "upto", "source_size", "target")
    finish = (F.col("source_size") * F.col("pass") + F.col("upto")) / F.col("target")
    order = ["finish", "source_rank", "pass", "key", "id", "size", "row"]
    each = each.withColumn("finish", finish).withColumn("slice", F.floor(_stretch(F.col("finish")) * pieces))
    # the total of each slice of time, so that only the slice of the cut is sorted
    slices = each.groupBy("slice").agg(F.sum("size").alias("sum")).withColumn("upto", F.sum("sum").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)))
    cut = slices.where(F.col("upto") > F.lit(budget)).orderBy("slice").limit(1).first()
    if cut is None:
        inside = F.lit(True)
    else:
        room = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        fits = each.where(F.col("slice") == cut["slice"]).withColumn("sum", F.sum("size").over(room) + (cut["upto"] - cut["sum"]))
        last = fits.where(F.col("sum") <= F.lit(budget)).agg(F.max(F.struct(*order)).alias("last")).first()["last"]
        inside = F.col("slice") < cut["slice"]
        if last is not None:
            inside |= F.struct(*order) <= F.struct(*[_literal(last[c], each.schema[c].dataType).alias(c) for c in order])
    passes = each.where(inside).groupBy("row").agg(F.count("*").alias("passes"))
    out = queue.join(passes, "row", "left").withColumn("passes", F.coalesce("passes", F.lit(0).cast("long")))
    own = [F.col("row").alias(row_col)] if row_col else []
    return out.select(F.col("id").alias(id_col), *own, "source", "size", "source_size", "target", "passes", (F.col("size") * F.col("passes")).alias("taken"))
