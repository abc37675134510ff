"""Near duplicates by SimHash, linked through a segment-popcount embedding.

A 64-bit fingerprint maps to the numbers of set bits in 32 segments of 2. The
Manhattan distance of two such vectors is a lower bound of the Hamming distance, so
fingerprints that differ in 2 bits or fewer lie within distance 2 of each other in
the grid of vectors, and both within distance 1 of a common cell. The range join puts
each distinct fingerprint into its own cell and its neighbours at distance 1 (65 at
most), joins on the cells that several share, and takes the pairs within distance 2 as
candidates; each is verified by its Hamming distance within the join. Equal texts are
one fingerprint from the start. A cell with many fingerprints is cut into parts, and
each pair of parts is joined under a key of its own.

Segments of 2 and not of 4 or 8: unrelated fingerprints are within distance 2 with a
probability of 2e-11, against 4e-7 for 16 segments of 4, so that the candidates of
10**10 fingerprints are about as many as these.

simhash_components() names those links. near_duplicates() takes them as candidates, whole
chains of them, and decides by Jaccard similarity, at which whole texts differ in more
bits than a grid can hold; equal fingerprints of min-wise samples and common rare
shingles of short texts are candidates too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import components, discard, materialize, pick, slices

#: Fixed values of the query: words of a shingle, seed of XXH64.
SHINGLE, SEED = 3, 42
#: Fingerprints of a cell that one key of the range join has on each side, about; cells
#: of a fingerprint, at most, and of the fingerprints of a task.
CELL_PART, CELLS, TASK_CELLS = 512, 65, 500_000
#: Near duplicates by similarity: words of a shingle, least Jaccard similarity, and
#: the samples: how many, and shingles in each. A pair at the least similarity shares
#: a sample with probability 1 - (1 - 0.8**5)**16 = 0.998, and less for few shingles:
#: 0.9976 for 52 of 65, none for 4 of 5. Pairs of documents with FEW shingles at most
#: are found without samples, all of them.
NEAR_SHINGLE, NEAR_SIMILARITY, SAMPLES, SAMPLE_SIZE, FEW = 5, 0.8, 16, 5, 64
#: Members that are compared with their group's first document in one task, or of
#: each side of a block; shingles of a side of a block.
GROUP_PART, PART_SHINGLES = 200, 1 << 18


def shingle_hashes(text: str | None, width: int, seed: int = SEED):
    """Arrays of XXH64 values of the shingles, repeats included, 2**16 at a time. Fewer
    words than ``width`` make one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 16):
        part = zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])
        yield np.array([digest(joined[a:b], seed) for a, b in part], dtype=np.uint64)


def majority(parts) -> int:
    """The fingerprint of hashes: each bit that is set in over half of them."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for h in parts:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0]) if n else 0


def signed(values) -> np.ndarray:
    return np.asarray(values, dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp) for each row; fp is the fingerprint as a signed long."""
    rows = pick(docs, id=id_col, text=text_col)

    def made(batches):
        for b in slices(batches):
            fp = signed([majority(shingle_hashes(t, width)) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp)], names=["id", "fp"])

    return rows.mapInArrow(made, f"id {dict(rows.dtypes)['id']}, fp long")


#: The even bits of a long: where the segments of 2 bits begin.
_EVEN = 0x5555555555555555


def popcounts(fp: str) -> Column:
    """The numbers of set bits in the 32 segments, 2 bits each, as one long."""
    return F.expr(f"(({fp} ^ shiftrightunsigned({fp}, 1)) & {_EVEN}L) | shiftleft({fp} & shiftrightunsigned({fp}, 1) & {_EVEN}L, 1)")


def grid(fps: DataFrame) -> DataFrame:
    """(fp, cell, way): the cell of the popcounts of each fingerprint (way 0), and the
    cells at distance 1: one bit more in segment number way - 1, or one bit fewer in
    segment number -way - 1."""
    held = fps.select("fp", popcounts("fp").alias("own"), F.explode(F.sequence(F.lit(-32), F.lit(32))).alias("way"))
    held = held.withColumn("at", F.expr("cast(2 * (abs(way) - 1) as int)")).withColumn("count", F.expr("CASE WHEN way = 0 THEN 0 ELSE shiftrightunsigned(own, at) & 3L END"))
    # what changes a count of two bits to the next: 0 and 1 differ in 1, 1 and 2 in 3
    step = F.expr("CASE WHEN way = 0 THEN 0L WHEN way > 0 AND count = 0 OR way < 0 AND count = 1 THEN 1L WHEN way > 0 AND count = 1 OR way < 0 AND count = 2 THEN 3L END")
    held = held.withColumn("step", step).where("step is not null")
    return held.select("fp", F.expr("CASE WHEN way = 0 THEN own ELSE own ^ shiftleft(step, at) END").alias("cell"), F.col("way").cast("byte").alias("way"))


def hamming_links(fps: DataFrame) -> DataFrame:
    """(u, v): the pairs of fingerprints (distinct, column fp) that differ in 2 bits or
    fewer, u < v."""
    n = fps.count()
    # nearly all cells are of one fingerprint, so what a task counts is bounded by what it is dealt
    cells = grid(fps.repartition(max(1, -(-n * CELLS // TASK_CELLS))))
    shared = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(shared.select("cell", "n", F.ceil(F.col("n") / CELL_PART).cast("int").alias("parts")), rows=n * CELLS // 2)
    rows, pairs = (int(x or 0) for x in shared.agg(F.sum("n"), F.sum(F.expr("n * (n - 1D) / 2"))).first())
    met = materialize(cells.join(shared.drop("n"), "cell").withColumn("own", F.expr("cast(pmod(xxhash64(fp), parts) as int)")), rows=rows)
    left = met.select("cell", F.col("own").alias("i"), F.explode(F.expr("sequence(own, parts - 1)")).alias("j"), F.col("fp").alias("a"), F.col("way").alias("way_a"))
    right = met.select("cell", F.explode(F.expr("sequence(0, own)")).alias("i"), F.col("own").alias("j"), F.col("fp").alias("b"), F.col("way").alias("way_b"))
    # with one way, not 0, into a cell both are in one cell, where they meet as well
    candidates = left.join(right, ["cell", "i", "j"]).where("(i < j or a < b) and a <> b and (way_a = 0 or way_b = 0 or way_a <> way_b)")
    verified = candidates.where("bit_count(a ^ b) <= 2")
    links = materialize(verified.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), rows=pairs)
    discard(shared, met)
    return links


def chains(fps: DataFrame) -> DataFrame:
    """(node, component): the fingerprints (distinct, column fp) that are linked with
    others, and the smallest that a chain of links reaches."""
    links = hamming_links(fps)
    found = components(links, rows=links.count())
    discard(links)
    return found


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``docs``: the fingerprint of the
    whole text in 16 hexadecimal digits, and the smallest id that a chain of links
    reaches, itself included.

    Texts without words, null among them, have fingerprint zero. Equal fingerprints
    are one node however many rows have them. Repeated rows get the same values; null
    ids count as larger than any other; an empty table gives none.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, width))
    n = rows.count()
    firsts = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), rows=n)
    found = chains(firsts.select("fp"))
    node = materialize(firsts.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), rows=n)
    least = node.groupBy("component").agg(F.min("first").alias("component_id"))
    label = materialize(node.join(least, "component").select("fp", "component_id"), rows=n)
    discard(firsts, node)
    named = rows.join(label, "fp")
    return named.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _sampled(whole: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The fingerprints of the samples of a set of shingles, all samples at once: each
    factor orders the shingles in its own way."""
    if len(whole) <= SAMPLE_SIZE:
        return np.repeat(np.uint64(majority([whole])), len(factors))
    taken = []
    for some in np.array_split(factors, max(1, len(factors) * len(whole) >> 16)):  # 65,536 values at a time
        order = whole[None, :] * some[:, None]
        order ^= order >> np.uint64(29)
        order *= some[:, None]
        taken.append(whole[np.argpartition(order, SAMPLE_SIZE, axis=1)[:, :SAMPLE_SIZE]])
    taken = np.ascontiguousarray(np.concatenate(taken))
    bits = np.unpackbits(taken.view(np.uint8).reshape(len(factors), SAMPLE_SIZE, 8), axis=2, bitorder="little")
    return np.packbits(2 * bits.sum(axis=1, dtype=np.int64) > SAMPLE_SIZE, axis=1, bitorder="little").view(np.uint64)[:, 0]


def _samples(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, fps, few): the number of different shingles, and a fingerprint of each
    of SAMPLES samples, the shingles with the SAMPLE_SIZE smallest values under the
    sample's own order; last, the fingerprint of the whole text. ``few`` has the
    shingles where there are FEW at most."""
    rows = pick(docs, id=id_col, text=text_col).where("id is not null")
    random = np.random.Generator(np.random.PCG64(7))
    factors = random.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def made(batches):
        for b in slices(batches):
            n, out, few = [], [], []
            for text in b.column("text").to_pylist():
                parts = list(shingle_hashes(text, width)) or [np.zeros(0, dtype=np.uint64)]
                whole = np.unique(np.concatenate(parts))
                n.append(len(whole))
                few.append(signed(whole if len(whole) <= FEW else whole[:0]))
                fps = _sampled(whole, factors)
                out.append(signed([*fps, majority(parts)]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(out, pa.list_(pa.int64())), pa.array(few, pa.list_(pa.int64()))], names=["id", "n", "fps", "few"])

    return rows.mapInArrow(made, f"id {dict(rows.dtypes)['id']}, n long, fps array<long>, few array<long>")


def _rarest(found: DataFrame, similarity: float) -> DataFrame:
    """(id, n, sample, fp): of each document with FEW shingles at most the rarest among
    such documents, as many as it must share one of with any that is similar enough:
    of n shingles ``similarity`` * n at least are common, so that not all of n - that
    + 1 can be others. Those that no other row has are left out. ``sample`` is -1."""
    rows = found.where("size(few) > 0").select("row", "id", "n", F.explode("few").alias("fp"))
    held = rows.groupBy("fp").agg(F.count("*").alias("held")).where("held > 1")
    held = rows.join(held, "fp", "left").withColumn("held", F.coalesce("held", F.lit(1).cast("long")))
    order = held.groupBy("row", "id", "n").agg(F.sort_array(F.collect_list(F.struct("held", "fp"))).alias("order"))
    first = F.slice("order", 1, (F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).cast("int"))
    return order.select("id", "n", F.lit(-1).alias("sample"), F.explode(first).alias("one")).where("one.held > 1").select("id", "n", "sample", "one.fp")


def _shingle_sets(rows: DataFrame, columns: str, width: int) -> DataFrame:
    """``columns`` of ``rows``, which have a column text, and the set of shingles of
    the text, by the lower halves of their hashes in order."""
    names = [c.split()[0] for c in columns.split(", ")]

    def made(batches):
        for b in slices(batches):
            out = []
            for text in b.column("text").to_pylist():
                parts = list(shingle_hashes(text, width)) or [np.zeros(0, dtype=np.uint64)]
                out.append(np.unique(np.concatenate(parts).astype(np.uint32)).view(np.int32))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.list_(pa.int32()))], names=[*names, "shingles"])

    return rows.select(*names, "text").mapInArrow(made, f"{columns}, shingles array<int>")


def _links_of_the_rest(rest: DataFrame, links: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(u, v): links that join what ``links`` leave apart within groups. ``rest`` has
    (sample, fp, id, n), the groups without their first documents.

    Groups that lie in one component are done. Others are cut into parts: a component
    with many members in the group has parts of its own, the small ones share parts.
    Each pair of parts is compared in a task of its own, but for pairs of one
    component; pairs of documents that are connected by then are passed over."""
    group = ["sample", "fp"]
    id_type = dict(rest.dtypes)["id"]
    n = links.count()
    label = materialize(components(links, rows=n), rows=2 * n)
    all_ = rest.groupBy(*group, "id").agg(F.max("n").alias("n")).join(label.withColumnRenamed("node", "id"), "id", "left")
    all_ = materialize(all_.withColumn("component", F.coalesce("component", "id")))
    apart = all_.groupBy(*group).agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y")
    )
    # groups with the same members are searched once
    apart = apart.where("low < high").groupBy("members", "x", "y").agg(F.min(F.struct(*group)).alias("group")).select("group.*")
    apart = materialize(apart)
    if apart.isEmpty():
        return links.where("1 = 0")
    rest = materialize(all_.join(apart, group))
    discard(all_)
    fill = lambda: F.ceil(F.greatest(F.sum("members") / GROUP_PART, F.sum("n") / PART_SHINGLES)).cast("int")
    own = rest.groupBy(*group, "component").agg(F.count("*").alias("members"), F.sum("n").alias("n"))
    own = materialize(own.withColumn("large", (F.col("members") >= GROUP_PART) | (F.col("n") >= PART_SHINGLES)))
    large = own.where("large").groupBy(*group, "component").agg(fill().alias("parts"))
    small = own.where("not large").groupBy(*group).agg(fill().alias("parts")).withColumn("component", F.lit(None).cast(id_type))
    kinds = materialize(large.unionByName(small[large.columns]))
    parts = materialize(kinds.select(*group, F.col("component").alias("of"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    name = F.struct(F.col("of"), F.col("part"))
    left, right = (parts.select(*group, F.col("of").alias(f"of_{side}"), name.alias(side)) for side in "ij")
    blocks = left.join(right, group).where("i <= j and (of_i is null or of_j is null or of_i <> of_j)").select(*group, "i", "j")
    # each block with its left part, and with its right part where that is another
    sides = blocks.select(*group, "i", "j", F.col("i").alias("own"), F.lit(0).alias("side"))
    sides = sides.unionByName(blocks.where("i <> j").select(*group, "i", "j", F.col("j").alias("own"), F.lit(1).alias("side")))
    sides = sides.select(*group, F.md5(F.to_json(F.struct("i", "j"))).alias("block"), (F.col("i") == F.col("j")).alias("alone"), "side", F.col("own.of").alias("of"), F.col("own.part").alias("part"))
    rest = rest.join(own.select(*group, "component", "large"), [*group, "component"]).withColumn("of", F.when(F.col("large"), F.col("component")))
    kinds_, kinds = kinds, kinds.select(*group, F.col("component").alias("_of"), "parts")
    same = [rest[c] == kinds[c] for c in group]
    rest = rest.join(kinds, [*same, rest["of"].eqNullSafe(kinds["_of"])]).select(*(rest[c] for c in group), "id", "component", "of", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    rest = materialize(rest)
    same = [rest[c] == sides[c] for c in (*group, "part")]
    asked = rest.join(sides, [*same, rest["of"].eqNullSafe(sides["of"])]).select(*(rest[c] for c in group), "block", "alone", "side", "id", "component")
    sets = materialize(_shingle_sets(texts.join(rest.select("id").distinct(), "id"), f"id {id_type}", width))
    columns = [*group, "block", "alone", "side", "id", "component", "shingles"]
    dealt = asked.join(sets, "id").select(*columns).repartition(*group, "block").sortWithinPartitions(*group, "block", "side", "id")

    def search(held):
        """Pairs of ids of the members (alone, side, id, component, shingles)."""
        held = [h for h in held if len(h[4])]
        if len({h[3] for h in held}) < 2:
            return []
        names: dict = {}
        root = np.array([names.setdefault(h[3], len(names)) for h in held])
        size, side = np.array([len(h[4]) for h in held]), np.array([h[1] for h in held])
        words, at = np.unique(np.concatenate([h[4] for h in held]), return_inverse=True)
        own = np.split(at.astype(np.int32), np.cumsum(size)[:-1])
        marked, out = np.zeros(len(words), dtype=bool), []
        for i, h in enumerate(held):
            if not h[0] and h[1]:
                break
            near = (root != root[i]) & (np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]))
            near &= np.arange(len(held)) > i if h[0] else side == 1
            found = np.flatnonzero(near).tolist()
            if not found:
                continue
            marked[own[i]] = True
            for j in found:
                if root[i] != root[j]:
                    both = int(np.count_nonzero(marked[own[j]]))
                    if both >= similarity * (size[i] + size[j] - both):
                        out.append((h[2], held[j][2]))
                        root[root == root[j]] = root[i]
            marked[own[i]] = False
        return out

    def compare(batches):
        def record(pairs):
            u, v = zip(*pairs)
            return pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], names=["u", "v"])

        key, held, kind = None, [], None
        for b in slices(batches):
            kind = b.schema.field("id").type
            rest = zip(*(b.column(c).to_pylist() for c in ("sample", "fp", "block", "alone", "side", "id", "component")))
            for r, (*k, alone, side, i, c) in enumerate(rest):
                if k != key:
                    if pairs := search(held):
                        yield record(pairs)
                    key, held = k, []
                held.append((alone, side, i, c, b.column("shingles")[r].values.to_numpy().copy()))
        if pairs := search(held):
            yield record(pairs)

    found = materialize(dealt.mapInArrow(compare, f"u {id_type}, v {id_type}"))
    discard(sets, rest, parts, own, kinds_, apart, label)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = NEAR_SHINGLE, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """(id, component_id) for the ids of ``docs`` that are in a group of near
    duplicates: documents connected by links of Jaccard similarity ``similarity`` or
    more between their sets of shingles, component_id being the smallest.

    Fingerprints of whole texts that differ in 2 bits or fewer are found by the grid of
    popcounts; the documents of a chain of them are a group. At that similarity they
    differ in 10 bits or so, far beyond what a grid can hold, so candidates come from
    fingerprints of samples of shingles as well, which must be equal, and from the
    rarest shingles of documents with few, which are prefixes that similar documents
    cannot but share. In each group every document
    is compared with the first one, on the whole sets; then those that no links
    connect so far are compared with each other. Rows without id are in no
    group, nor are texts without words unless there are several; rows with one id are
    one document.
    """
    found = materialize(_samples(docs, id_col, text_col, width).withColumn("row", F.monotonically_increasing_id()))
    each = found.select("id", "n", F.posexplode(F.slice("fps", 1, SAMPLES)).alias("sample", "fp"))
    own = found.select("id", "n", F.lit(SAMPLES).alias("sample"), F.element_at("fps", -1).alias("fp"))
    distinct = materialize(own.select("fp").distinct(), rows=found.count())
    own = own.join(chains(distinct).withColumnRenamed("node", "fp"), "fp", "left").withColumn("fp", F.coalesce("component", "fp"))
    each = each.unionByName(own.drop("component"))
    each = each.unionByName(materialize(_rarest(found, similarity)))
    firsts = each.groupBy("sample", "fp").agg(F.min(F.struct("id", "n")).alias("first"), F.max("id").alias("last")).where("first.id < last")
    firsts = materialize(firsts.select("sample", "fp", F.col("first.id").alias("b"), F.col("first.n").alias("m")))
    pairs = each.join(firsts, ["sample", "fp"]).where("id <> b").where(F.least("n", "m") >= similarity * F.greatest("n", "m"))
    pairs = materialize(pairs.select(F.col("id").alias("a"), "b").distinct())
    # a first document with many others is copied to as many parts as they fill
    parts = materialize(pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP_PART).cast("int").alias("parts")))
    members = pairs.join(parts, "b").select(F.col("a").alias("id"), "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    heads = parts.select(F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    asked = members.unionByName(heads)
    texts = pick(docs, id=id_col, text=text_col)
    id_type = dict(texts.dtypes)["id"]

    whole = _shingle_sets(texts.join(asked, "id"), f"id {id_type}, b {id_type}, part int, role int", width)

    def compare(batches):
        head, first = None, None
        for b in slices(batches):
            keep = []
            for i, (key, part, role) in enumerate(zip(b.column("b").to_pylist(), b.column("part").to_pylist(), b.column("role").to_pylist())):
                have = b.column("shingles")[i].values.to_numpy()
                if role == 0:
                    head, first = (key, part), have.copy()
                elif head == (key, part):
                    both = len(np.intersect1d(first, have, assume_unique=True))
                    if both >= similarity * (len(first) + len(have) - both):
                        keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(keep, pa.int64())) for c in ("id", "b")], names=["u", "v"])

    dealt = whole.repartition("b", "part").sortWithinPartitions("b", "part", "role")
    links = materialize(dealt.select("id", "b", "part", "role", "shingles").mapInArrow(compare, f"u {id_type}, v {id_type}"))
    rest = each.join(firsts, ["sample", "fp"]).where("id <> b").select("sample", "fp", "id", "n")
    more = _links_of_the_rest(rest, links, texts, width, similarity)
    out = components(links.unionByName(more), rows=links.count() + more.count())
    discard(found, distinct, firsts, pairs, parts, links)
    return out.select(F.col("node").alias("id"), F.col("component").alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, without those near duplicates that are not
    the first of their group."""
    go = materialize(near_duplicates(docs, id_col, text_col, **options).where("id <> component_id").select("id"))
    return docs.join(go, docs[id_col] == go["id"], "left_anti")
