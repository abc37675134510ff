"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are shares of kinds of characters,
lengths and repetition, of itself and of both neighbouring lines; the chain adds
weights for pairs of neighbouring labels. Forward-backward gives each line the
probability that it is good; their average, weighted by the lines' lengths, is the
document's quality, which a logistic curve turns into its score.

Training reads a bounded sample of labelled documents (SAMPLE of each label, CHAINS
chains of CHAIN lines of each) and takes a document's label as that of all its lines.
No label, language, source or id is an input of a score, and scoring cuts nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_sample, pick, slices

#: What bounds training: labelled documents of each label, lines of a chain, and chains
#: of a document, spread evenly over it from its first line to its last. The driver gets
#: 2 * SAMPLE * CHAINS * CHAIN lines of N_FEATURES numbers of 4 bytes at most: 90 MB.
SAMPLE, STEPS, CHAIN, CHAINS = 1500, 100, 64, 2

_KIND = np.full(256, 6, dtype=np.int64)  # bytes of other scripts
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\f\v", b".,;:'\"?()-")):
    _KIND[list(_chars)] = _k
_KIND[[b for b in range(128) if _KIND[b] == 6]] = 5  # other symbols
N_OWN = 19
N_FEATURES = 3 * N_OWN + 1


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, length) of the lines of a text, a row for each line; the empty text,
    and null, have one empty line."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    lines = raw.split(b"\n")
    n = len(lines)
    length = np.array([len(x) for x in lines], dtype=np.float64)
    codes = np.frombuffer(raw, dtype=np.uint8)
    line = np.repeat(np.arange(n), np.array([len(x) + 1 for x in lines]))[: len(codes)]
    kinds = np.bincount(line * 8 + _KIND[codes], minlength=8 * n).reshape(n, 8)[:, :7].astype(np.float64)
    kinds[:-1, 5] -= 1  # the line break itself
    words, different, again, known = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    seen: set[bytes] = set()
    for i, x in enumerate(lines):
        w = x.split()
        words[i], different[i] = len(w), len(set(w))
        again[i] = sum(map(bytes.__eq__, w, w[1:]))
        known[i] = x in seen and len(w) > 0
        seen.add(x)
    own = np.zeros((n, N_OWN))
    size = np.maximum(length, 1)
    share = kinds / size[:, None]
    own[:, :7] = share
    count = np.maximum(words, 1)
    own[:, 7], own[:, 8] = np.log1p(length) / 5, np.log1p(words) / 4
    own[:, 9] = np.minimum(length / count, 30) / 10
    own[:, 10], own[:, 11], own[:, 12] = different / count, again / count, known
    own[:, 13], own[:, 14], own[:, 15] = share[:, 0] > 0.3, share[:, 5] > 0.04, (different / count < 0.6) & (words > 12)
    own[:, 16], own[:, 17] = words < 4, again / count > 0.2
    own[:, 18] = np.array([x[-1:] in b".!?" and len(x) > 0 for x in lines])
    out = np.zeros((n, N_FEATURES))
    out[:, :N_OWN] = own
    out[1:, N_OWN : 2 * N_OWN] = own[:-1]
    out[:-1, 2 * N_OWN : 3 * N_OWN] = own[1:]
    out[:, -1] = 1
    return out, length + 1


def chains(lines: int) -> np.ndarray:
    """Which of so many lines training reads."""
    if lines <= CHAIN * CHAINS:
        return np.arange(lines)
    starts = np.linspace(0, lines - CHAIN, CHAINS).astype(np.int64)
    return (starts[:, None] + np.arange(CHAIN)).reshape(-1)


@dataclass
class Model:
    """``weights`` of a line's features for good against bad; ``pairs`` the weights of
    (bad, bad), (bad, good), (good, bad), (good, good); ``slope`` and ``base`` of the
    logistic curve over document quality."""

    weights: np.ndarray
    pairs: tuple[float, float, float, float]
    slope: float = 1.0
    base: float = 0.0

    def marginals(self, features: np.ndarray) -> np.ndarray:
        """The probability of each line that it is good, by forward-backward over the
        log-odds of good against bad."""
        own = (features @ self.weights).tolist()
        bb, bg, gb, gg = self.pairs
        forward, back, u, v = [], [0.0] * len(own), None, 0.0
        for e in own:
            u = e if u is None else e + _log_ratio(bg, gg + u, bb, gb + u)
            forward.append(u)
        for t in range(len(own) - 2, -1, -1):
            v += own[t + 1]
            v = _log_ratio(gb, gg + v, bb, bg + v)
            back[t] = v
        return 1 / (1 + np.exp(-np.clip(np.array(forward) + np.array(back), -40, 40)))

    def quality(self, features: np.ndarray, length: np.ndarray) -> float:
        return float(self.marginals(features) @ length / length.sum())

    def score(self, text: str | None) -> float:
        q = self.quality(*line_features(text))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * q + self.base))))


def _log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def _log_ratio(a: float, b: float, c: float, d: float) -> float:
    return _log_add(a, b) - _log_add(c, d)


def train(docs: list[tuple[int, np.ndarray, np.ndarray]], steps: int = STEPS) -> Model:
    """From (label, features, lengths) of each document; the likelihood of all lines
    having their document's label, classes weighted equally, by Adam."""
    if len({label for label, _, _ in docs}) < 2:
        only = docs[0][0] if docs else 1
        return Model(np.zeros(N_FEATURES), (0.0,) * 4, 0.0, 2.0 if only else -2.0)
    whole = docs
    docs = [(c, x[i : i + CHAIN], n[i : i + CHAIN]) for c, x, n in docs for i in range(0, len(x), CHAIN)]
    docs.sort(key=lambda d: -len(d[1]))
    labels = np.array([d[0] for d in docs], dtype=np.float64)
    sizes = np.array([len(d[1]) for d in docs])
    x = np.concatenate([d[1] for d in docs])
    doc_of = np.repeat(np.arange(len(docs)), sizes)
    ends = np.cumsum(sizes)
    column = np.arange(len(x)) - np.repeat(ends - sizes, sizes)
    weight = np.where(labels == 1, 1 / max(1, labels.sum()), 1 / max(1, (1 - labels).sum())) / np.sqrt(sizes)
    active = [int((sizes > t).sum()) for t in range(sizes.max())]  # documents are in order of size
    theta = np.zeros(N_FEATURES + 4)
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        e, pairs = x @ theta[:-4], theta[-4:].reshape(2, 2)
        grid = np.zeros((len(docs), len(active)))
        grid[doc_of, column] = e
        f = np.zeros((len(docs), len(active), 2))
        b = np.zeros_like(f)
        f[:, 0, 1] = grid[:, 0]
        for t in range(1, len(active)):
            k = active[t]
            f[:k, t] = np.logaddexp(f[:k, t - 1, 0, None] + pairs[0], f[:k, t - 1, 1, None] + pairs[1])
            f[:k, t, 1] += grid[:k, t]
        for t in range(len(active) - 2, -1, -1):
            k = active[t + 1]
            ahead = b[:k, t + 1].copy()
            ahead[:, 1] += grid[:k, t + 1]
            b[:k, t] = np.logaddexp(ahead[:, 0, None] + pairs[:, 0], ahead[:, 1, None] + pairs[:, 1])
        total = np.logaddexp(b[:, 0, 0], b[:, 0, 1] + grid[:, 0])
        good = np.exp(np.clip(f[:, :, 1] + b[:, :, 1] - total[:, None], -50, 0))[doc_of, column]
        slope = np.zeros_like(theta)
        slope[:-4] = x.T @ ((labels[doc_of] - good) * weight[doc_of])
        want = np.zeros((2, 2))
        for t in range(1, len(active)):
            k = active[t]
            at = f[:k, t - 1, :, None] + pairs + b[:k, t, None, :] - total[:k, None, None]
            at[:, :, 1] += grid[:k, t, None]
            want -= np.einsum("i,iab->ab", weight[:k], np.exp(np.clip(at, -50, 0)))
        for c in (0, 1):
            want[c, c] += (weight * (sizes - 1))[labels == c].sum()
        slope[-4:] = want.reshape(-1)
        slope -= 1e-3 * theta
        m, s = 0.9 * m + 0.1 * slope, 0.999 * s + 0.001 * slope**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
    model = Model(theta[:-4], tuple(theta[-4:].tolist()))
    q = np.array([model.quality(a, n) for _, a, n in whole])
    labels = np.array([label for label, _, _ in whole], dtype=np.float64)
    side = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    line = np.zeros(2)  # the logistic curve, by Newton's method
    z = np.stack((q, np.ones_like(q)), axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ line, -40, 40)))
        grad = z.T @ (side * (labels - p)) - 1e-4 * line
        line = line + np.linalg.solve((z * (side * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2), grad)
    model.slope, model.base = map(float, line)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample: int = SAMPLE) -> Model:
    """A model from the labelled rows whose crc32(id as text) mod 3 is not 1, at most
    ``sample`` documents of each label and of each the lines of ``chains``. Of several
    labels of one id the largest counts, of several texts that with the least md5. Null
    labels and null ids teach nothing."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(~held_out(F.col("id")))
    marks = marks.where("label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    chosen = [bounded_sample(marks.where(F.col("label") == c), marks.where(F.col("label") == c).select("id"), "id", sample) for c in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])  # two times sample rows at most
    texts = pick(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "label").agg(F.min(F.struct(F.md5(F.coalesce("text", F.lit(""))).alias("md5"), "text")).alias("t")).select("id", "label", "t.text")

    def features(batches):
        for b in slices(batches):
            made = []
            for text in b.column("text").to_pylist():
                x, n = line_features(text)
                made.append((x[chains(len(n))], n[chains(len(n))]))
            x = pa.array([m[0].astype(np.float32).tobytes() for m in made], pa.binary())
            n = pa.array([m[1].astype(np.float32).tobytes() for m in made], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), x, n], names=["id", "label", "x", "n"])

    rows = texts.mapInArrow(features, f"id {dict(texts.dtypes)['id']}, label int, x binary, n binary").collect()
    rows.sort(key=lambda r: (r["label"], r["id"], bytes(r["x"])))
    as_array = lambda raw: np.frombuffer(bytes(raw), dtype=np.float32).astype(np.float64)
    return train([(r["label"], as_array(r["x"]).reshape(-1, N_FEATURES), as_array(r["n"])) for r in rows])


def held_out(id_):
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1, higher is better) of each whole text in
    ``into``. Null and empty texts have the score of one empty line."""
    of = F.pandas_udf(lambda texts: texts.map(model.score), "double")
    return docs.withColumn(into, of(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, score, predicted) for each row of ``docs``; held_out marks the
    ids that never teach (null ids are not marked). Repeated rows get equal scores; an
    empty table gives no rows, and without labels of both kinds all scores are equal.
    """
    model = fit(docs, labels, id_col, text_col, label_col, sample=sample)
    scored = score_quality(pick(docs, id=id_col, text=text_col), model)
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
