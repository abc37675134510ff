"""Near duplicates of embeddings by Euclidean p-stable hashing.

Vectors are normalised; each of TABLES hash tables projects them on PROJECTIONS
random directions and quantises the values in steps of WIDTH. Vectors of one label in
one bucket are compared by exact cosine in double precision.

For unit vectors a cosine of 0.98 is a distance of 0.2: a projection agrees with
probability 0.894, so a pair at the threshold meets in some table with probability
1 - (1 - 0.894**14)**32 = 0.9994, while unrelated vectors meet with 0.388**14 = 2e-6
in a table. Equal vectors of one label are one class from the start, known by the
digest of its numbers. Of buckets with the same members, as a cluster has them in most
tables, only that of the first table is compared. Buckets have no cap: a large one is
cut into parts, and each pair of parts is compared in a task of its own, block by
block; what leaves a task are counts and stars, never the pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import components, discard, materialize, pick, slices

#: The production parameters.
COSINE, TABLES, PROJECTIONS, WIDTH, SEED, PART = 0.98, 32, 14, 1.5, 11, 512


def _unit(rows: list) -> list:
    """Unit vectors, or None for those that link with nothing."""
    out = []
    for r in rows:
        v = None if r is None or any(x is None for x in r) else np.asarray(r, dtype=np.float64)
        if v is None or not len(v) or not np.isfinite(v).all() or not v.any():
            out.append(None)
        else:
            v = v / np.abs(v).max()
            out.append(v / np.sqrt(v @ v) + 0.0)  # no zero keeps a sign
    return out


def _buckets(unit: np.ndarray, label: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """A name of the bucket of each row in each table, with its label, length and table
    in it."""
    random = np.random.Generator(np.random.PCG64([SEED, unit.shape[1]]))
    lines = random.standard_normal((unit.shape[1], tables * projections))
    shifts = random.uniform(0, width, tables * projections)
    steps = np.floor((unit @ lines + shifts) / width).astype(np.int64).view(np.uint64).reshape(len(unit), tables, projections)
    name = np.repeat(label.astype(np.int64).view(np.uint64)[:, None], tables, axis=1)
    for part in (np.uint64(unit.shape[1]), np.arange(tables, dtype=np.uint64), *(steps[:, :, i] for i in range(projections))):
        name = (name ^ (name >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + part
    name = (name ^ (name >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (name ^ (name >> np.uint64(29))).view(np.int64)


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", *, cosine: float = COSINE, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, part: int = PART) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``vectors``: the number of
    other rows with a cosine of ``cosine`` or more and the same label, the smallest id
    that links reach, itself included, and whether that is its own.

    A row with a null label, or a vector that is null, empty, zero, or holds a null or
    a value that is not finite, has no links; vectors of different lengths do not link
    and are never in one bucket. Repeated rows link with each other; a null id counts
    as larger than others. An empty table gives no rows. Labels are whole numbers.
    """
    given = pick(vectors, id=id_col, vec=vec_col, label=label_col).withColumn("label", F.col("label").cast("long"))
    id_type = dict(given.dtypes)["id"]

    def normalise(batches):
        for b in slices(batches, 1000):
            unit, labels = _unit(b.column("vec").to_pylist()), b.column("label").to_pylist()
            code = [None if v is None or c is None else hashlib.md5(b"%d:" % c + v.tobytes()).digest() for v, c in zip(unit, labels)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(code, pa.binary()), pa.array(unit, pa.list_(pa.float64()))], names=["id", "label", "code", "unit"])

    rows = materialize(given.mapInArrow(normalise, f"id {id_type}, label long, code binary, unit array<double>"))
    classes = rows.where("code is not null").groupBy("code").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.first("label").alias("label"), F.first("unit").alias("unit"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()))

    def hash_rows(batches):
        for b in batches:
            unit, label, out = b.column("unit"), b.column("label").to_numpy(), np.zeros((b.num_rows, tables), dtype=np.int64)
            lengths = np.diff(unit.offsets.to_numpy())
            for d in np.unique(lengths):
                mine = np.flatnonzero(lengths == d)
                out[mine] = _buckets(np.stack([unit[int(i)].values.to_numpy() for i in mine]), label[mine], tables, projections, width)
            names = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("class"), names], names=["class", "names"])

    named = materialize(classes.select("class", "label", "unit").mapInArrow(hash_rows, "class long, names array<long>"))
    at = named.select("class", F.posexplode("names").alias("table", "name"))
    sizes = at.groupBy("table", "name").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("y")).where("size > 1")
    # a pair counts where it first meets, which no bucket with the same members precedes
    sizes = materialize(sizes.groupBy("size", "x", "y").agg(F.min(F.struct("table", "name")).alias("at")).select("at.*", "size"))
    met = at.join(sizes, ["table", "name"]).withColumn("parts", F.ceil(F.col("size") / part).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("class", "table", "name", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"))
    met = met.join(classes.select("class", "n", "unit"), "class").join(named, "class")

    def compare(batches):
        key, held = None, []

        def links():
            first = [h for h in held if h[1]]
            second = first if key[2] == key[3] else [h for h in held if not h[1]]
            if not first or not second or len(held) < 2:
                return []
            a, b = (np.array([h[0] for h in side]) for side in (first, second))
            near = np.stack([h[3] for h in first]) @ np.stack([h[3] for h in second]).T >= cosine
            near &= a[:, None] != b[None, :]
            x, y = np.nonzero(near)
            if not len(x):
                return []
            # a pair counts in the first of the tables where it meets
            one, two = np.stack([h[4] for h in first]), np.stack([h[4] for h in second])
            add_a, add_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            n_a, n_b = np.array([h[2] for h in first]), np.array([h[2] for h in second])
            for at in range(0, len(x), 1 << 14):
                p, q = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
                new = np.argmax(one[p] == two[q], axis=1) == key[0]
                np.add.at(add_a, p[new], n_b[q[new]])
                if first is not second:
                    np.add.at(add_b, q[new], n_a[p[new]])
            label = {int(c): int(c) for c in np.concatenate((a, b))}
            for c, d in zip(a[x].tolist(), b[y].tolist()):
                while label[c] != c:
                    c = label[c]
                while label[d] != d:
                    d = label[d]
                if c != d:
                    label[max(c, d)] = min(c, d)
            total: dict[int, int] = {}
            for c, n in [*zip(a.tolist(), add_a.tolist()), *zip(b.tolist(), add_b.tolist())]:
                total[c] = total.get(c, 0) + n
            for c in set(total):
                root = label[c]
                while label[root] != root:
                    root = label[root]
                label[c] = root
            if first is second:
                total = dict(zip(a.tolist(), add_a.tolist()))
            return [(c, n, label[c]) for c, n in total.items() if n or label[c] != c]

        def record(found):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["class", "add", "root"])

        for b in batches:
            out = []
            keys = zip(*(b.column(c).to_pylist() for c in ("table", "name", "i", "j")))
            unit, names = b.column("unit"), b.column("names")
            rest = zip(*(b.column(c).to_pylist() for c in ("class", "left", "n")))
            for r, (k, (c, left, n)) in enumerate(zip(keys, rest)):
                if k != key:
                    out += links() if held else []
                    key, held = k, []
                held.append((c, left, n, unit[r].values.to_numpy(), names[r].values.to_numpy()))
            if out:
                yield record(out)
        if held and (out := links()):
            yield record(out)

    dealt = met.repartition("table", "name", "i", "j").sortWithinPartitions("table", "name", "i", "j", "class")
    found = materialize(dealt.select("table", "name", "i", "j", "class", "left", "n", "unit", "names").mapInArrow(compare, "class long, add long, root long"))
    others = found.groupBy("class").agg(F.sum("add").alias("others"))
    linked = components(found.select(F.col("class").alias("u"), F.col("root").alias("v")))
    label = classes.select("class", "code", "n", "first").join(others, "class", "left")
    label = label.join(linked.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    label = materialize(label)
    least = label.groupBy("component").agg(F.min("first").alias("component_id"))
    named_code = materialize(label.join(least, "component").select("code", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"))
    discard(classes, named, sizes, found, label)
    out = rows.select("id", "code").join(named_code, "code", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
