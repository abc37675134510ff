"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the hashes of all runs of GRAM words, the leftmost
least one in each window of WINDOW words. Equal windows choose the same anchor, so a
window that occurs twice has an anchor that occurs twice, and each window belongs to
one anchor. Documents are joined on anchors. An anchor's match is extended to both
sides as far as the windows that belong to it reach: where this whole context occurs
in a document with a smaller id, all its windows do. Only contexts that share an
anchor with a different context are extended word by word, and only the first
document of each such context: its windows are compared by their fingerprints. The
union of repeated windows, the maximal repeats, is removed.

Nothing is expanded into pairs of documents: an anchor, a context or a window that
occurs in a third of all documents is a row of a pre-aggregated table. Texts cross
the network compressed, once for the contexts and once for the removal.

Fingerprints have 96 bits: 32 of the anchor and 64 of the context or window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import discard, materialize, pick, slices

#: The production parameters: words of a window and of an anchor. A context has
#: WINDOW - GRAM + 1 windows at most, which must be 63 or fewer.
WINDOW, GRAM = 50, 12
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n or more of them."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, n.bit_length())
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS[0] = have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashed:
    """Fingerprints of the runs of words of one document."""

    def __init__(self, words: list[bytes]):
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
        up, self.down = _powers(len(words) + 1)
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up[: len(words)], dtype=np.uint64)))

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def contexts(self, n_words: int, window: int, gram: int) -> tuple[np.ndarray, ...]:
        """For each anchor, in order: its hash, the first window that belongs to it,
        their number, and the fingerprint of what they cover."""
        starts = np.arange(n_words - gram + 1)
        grams = self.runs(starts, starts + gram)
        width = window - gram + 1
        anchor = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(n_words - window + 1)
        first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        last = np.concatenate((first[1:] - 1, [len(anchor) - 1]))
        at = anchor[first]
        cover = self.runs(first, last + window)
        shape = ((at - first) * 64 + (last - first)).astype(np.uint64)
        return grams[at], first, last - first + 1, _mix(cover + _mix(shape + np.uint64(1)))


def _split(raw: bytes) -> list[bytes]:
    return raw.split()  # at just the six separators of a word


def _ids(batch, name="id"):
    return batch.column(name).to_numpy(zero_copy_only=False)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept_text]) for each row of ``docs``:
    words that lie in a window of ``window`` words which also starts in a row with a
    smaller id are removed; kept_sha256 is the digest of the words kept, joined by one
    space.

    Null texts have no words, texts below ``window`` words no windows. Rows with one
    id do not remove each other's words; a row without id removes nothing and loses
    nothing. An empty table gives no rows. Ids are whole numbers.
    """
    if not 0 < window - gram + 1 <= 63:
        raise ValueError("a context must have 1 to 63 windows")
    given = pick(docs, id=id_col, text=text_col)
    id_type = dict(given.dtypes)["id"]
    given = given.withColumn("code", F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF)))

    def anchors(batches):
        for b in slices(batches):
            out = []
            for i, code, text in zip(b.column("id").to_pylist(), b.column("code").to_pylist(), b.column("text").to_pylist()):
                words = _split((text or "").encode("utf-8", "surrogatepass"))
                if i is None or len(words) < window:
                    continue
                name, first, count, cover = Hashed(words).contexts(len(words), window, gram)
                name = (name >> np.uint64(32)).astype(np.int64) * 64 + count
                out.append((cover.view(np.int64), name, np.full(len(first), i, dtype=np.int64), first + (code << 31)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["cover", "name", "id", "at"])

    # name: the anchor's 32 bits, then the number of windows; at: code, then word
    every = materialize(given.mapInArrow(anchors, "cover long, name long, id long, at long"))
    anchor = F.shiftright("name", 6).alias("anchor")
    common = materialize(every.groupBy(anchor).agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor"))
    seen = materialize(every.withColumn("anchor", anchor).join(common, "anchor").drop("anchor"))
    discard(every, common)
    contexts = materialize(seen.groupBy("cover", "name").agg(F.min(F.struct("id", "at")).alias("m")).select("cover", "name", "m.id", "m.at"))
    several = contexts.groupBy(anchor).agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor")
    several = materialize(several)
    open_ = contexts.withColumn("anchor", anchor).join(several, "anchor")
    open_ = open_.select("id", F.shiftright("at", 31).alias("code"), F.struct(F.col("at").bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("first"), "cover", "name").alias("c"))
    wanted = open_.groupBy("id", "code").agg(F.collect_list("c").alias("cs"))

    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in slices(batches):
            out = [z.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("code"), pa.array(out, pa.binary())], names=["id", "code", "packed"])

    packed = given.mapInArrow(squeeze, f"id {id_type}, code long, packed binary")

    def extend(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in slices(batches):
            cs, out = b.column("cs"), []
            for r, (i, raw) in enumerate(zip(b.column("id").to_pylist(), b.column("packed").to_pylist())):
                hashed = Hashed(_split(unzip.decompress(raw)))
                c = cs[r].values
                first, cover, name = (c.field(k).to_numpy() for k in range(3))
                count = name & 63
                which = np.repeat(np.arange(len(first)), count)
                step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                start = first[which].astype(np.int64) + step
                prints = hashed.runs(start, start + window).view(np.int64)
                out.append((prints, cover[which], name[which] * 64 + step, np.full(len(which), i, dtype=np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["print", "cover", "place", "id"])

    # place: the name, then the number of the window
    windows = packed.where("id is not null").join(wanted, ["id", "code"]).select("id", "packed", "cs")
    windows = materialize(windows.mapInArrow(extend, "print long, cover long, place long, id long").withColumn("anchor", F.shiftright("place", 12)))
    least = materialize(windows.groupBy("print", "anchor").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most"))
    hits = windows.join(least, ["print", "anchor"]).where("id > least")
    masks = hits.groupBy("cover", F.shiftright("place", 6).alias("name")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("mask"))
    firsts, contexts = contexts, materialize(contexts.select("cover", "name", F.col("id").alias("least")).join(masks, ["cover", "name"], "left"))
    discard(firsts, several, windows, least)
    all_ = F.expr("shiftleft(1L, cast(name & 63 as int)) - 1L") if window - gram + 1 < 63 else F.expr("CASE WHEN name & 63 = 63 THEN 9223372036854775807L ELSE shiftleft(1L, cast(name & 63 as int)) - 1L END")
    repeats = seen.join(contexts, ["cover", "name"]).withColumn("mask", F.when(F.col("id") > F.col("least"), all_).otherwise(F.col("mask"))).where("mask is not null")
    repeats = repeats.select("id", F.shiftright("at", 31).alias("code"), F.struct(F.col("at").bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("first"), "mask").alias("r"))
    repeats = repeats.groupBy("id", "code").agg(F.collect_set("r").alias("rs"))

    def remove(batches):
        unzip = zstandard.ZstdDecompressor()
        bits = np.arange(63)
        for b in slices(batches):
            rs, out = b.column("rs"), []
            for r, raw in enumerate(b.column("packed").to_pylist()):
                words = _split(unzip.decompress(raw))
                n = len(words)
                if rs[r].is_valid:
                    first, mask = rs[r].values.field(0).to_numpy(), rs[r].values.field(1).to_numpy()
                    row, step = np.nonzero((mask[:, None] >> bits) & 1)
                    start = first[row].astype(np.int64) + step
                    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + window, minlength=n + 1)
                    covered = np.cumsum(edge)[:n] > 0
                    words = [w for w, gone in zip(words, covered.tolist()) if not gone]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if with_text else None))
            cols = list(zip(*out)) or [()] * 4
            arrays = [b.column("id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string())))]
            yield pa.RecordBatch.from_arrays(arrays[: 4 + with_text], names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text])

    out = packed.join(repeats, ["id", "code"], "left").select("id", "packed", "rs")
    out = out.mapInArrow(remove, f"id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    return out.withColumnRenamed("id", id_col)
