"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from a pattern for each of four kinds. The field then looks at every
candidate of a whole text: a run that looks like a number, an address or a key of mixed
letters and digits, whether or not a pattern took it. It labels each with a kind, with
secret, or with none. Candidates that follow each other closely are linked as a chain;
candidates with the same key (a number's last digits, an address's local part, the
first letters of a key), however far apart and however written, are linked by skip
edges and share a potential, so that what is found once in full is recognised where it
is repeated in another form. Loopy message passing labels all candidates of a document
together; candidates of base spans are fixed, and what else gets a label with
probability MARGINAL adds a span.

All weights, of features and of both kinds of edges, are learnt together by the
pseudo-likelihood of a bounded sample's candidates: the probability of each candidate's
label given its features and its neighbours' labels. Labels are the base spans and, for
secrets, quoted or assigned keys after a word like token. As no label says what a
repeated mention looks like, some are made: a labelled candidate without the sign that
its pattern needs (the + of a phone number, the word before a secret) keeps its label
where it is linked with the full mention and is none where it is linked with nothing or
with its like.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_sample, pick, slices

KINDS = ("email", "ip", "card", "phone")
#: The labels of the field, of which none is the first, and the label of secrets.
LABELS = ("none", *KINDS, "secret")
SECRET = LABELS.index("secret")
#: What bounds training: documents, candidates of a document (chosen by the digest of
#: their keys, so that those with one key stay together), and steps. The driver gets
#: SAMPLE * MOST rows of N_FEATURES numbers of 4 bytes at most: 90 MB.
SAMPLE, MOST, STEPS = 8000, 100, 1500
#: The production parameters: characters between neighbours of the chain, digits of a
#: number and of its key, letters of a secret and of its key, least probability of an
#: added span, rounds of messages and the change that ends them.
NEAR, LEAST_DIGITS, KEY_DIGITS, LEAST_LETTERS, KEY_LETTERS, MARGINAL, ROUNDS, SETTLED = 80, 7, 7, 16, 12, 0.9, 60, 1e-6
DECAY = 1e-5

#: The base patterns. The address is found from its @ outwards, and an
#: ip only where a run of digits begins; both give the matches of the plain patterns
#: without going through long runs again and again.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBER = re.compile(r"\+?\(?[0-9][\x20().0-9-]*[0-9]")
_ADDRESS = re.compile(r"[^\s@,;:<>()\"']*@[^\s@,;:<>()\"']*")
_OPAQUE = re.compile(r"[A-Za-z0-9_+/-]{16,}")
#: Words that come before a secret.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "auth", "bearer", "credential", "credentials")
_SIGNED = re.compile(r"(?:\b|_)(?:%s)\b[\s\"']*(?:=>|[=:]|\bis\b)?\s*[\"'`]?\Z" % "|".join(SECRET_WORDS), re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start; positions are code points."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


@dataclass
class Candidates:
    """The candidates of a text: spans, features, base kinds (0: no base span), labels
    for training, and the edges of the field (first, second, whether a skip edge)."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    base: np.ndarray
    labels: np.ndarray
    edges: np.ndarray


#: The features that a label's sign consists of, and those of a number's length.
SIGNS = {1: (2,), 2: (11,), 3: (14,), 4: (9,), 5: (20, 21, 22)}
LENGTHS, SHORT = (4, 5, 6, 7, 8), 4
N_FEATURES = 23


def _features(text: str, s: int, e: int) -> list[float]:
    x, before = text[s:e], text[max(0, s - 24) : s]
    digits, at = _digits(x), x.find("@")
    n, letters = len(digits), sum(c.isalpha() for c in x)
    hexadecimal = letters > 0 and n > 0 and not x.lower().strip("0123456789abcdef")
    shape = [1, at >= 0, at >= 0 and "." in x[at:], n == 0, 0 < n < 9, 9 <= n <= 12, 13 <= n <= 15, 15 < n <= 19, n > 19, x[:1] == "+", "(" in x, at < 0 and x.count(".") == 3, " " in x, "-" in x, 13 <= n <= 19 and luhn(digits), letters > 0]
    opaque = at < 0 and n > 0 and letters > 0
    shape += [opaque and len(x) < 32, opaque and len(x) >= 32, opaque and hexadecimal, opaque and any(c.isupper() for c in x) and any(c.islower() for c in x)]
    return [*shape, opaque and _SIGNED.search(before) is not None, before[-1:] in "\"'`" and text[e : e + 1] == before[-1:] != "", before.rstrip(" \"'`")[-1:] in ("=", ":")]


def _key(x: str) -> str:
    """What a mention has in common with others of the same thing."""
    plain = re.sub(r"[^a-z0-9]", "", x.lower())
    if "@" in x:
        local = re.sub(r"[^a-z0-9]", "", x[: x.index("@")].lower())
        return "@" + (local if len(local) > 3 else plain)
    digits = _digits(x)
    return digits[-KEY_DIGITS:] if len(digits) == len(plain) else "#" + plain[:KEY_LETTERS]


def candidates(text: str, base: list[tuple[int, int, int]]) -> Candidates:
    found = [(m.start(), m.end()) for m in _ADDRESS.finditer(text)] if "@" in text else []
    found += [(m.start(), m.end()) for m in _NUMBER.finditer(text) if len(_digits(m.group())) >= LEAST_DIGITS]
    for m in _OPAQUE.finditer(text):
        x = m.group()
        if any("0" <= c <= "9" for c in x) and any("a" <= c <= "z" for c in x.lower()):
            found.append((m.start(), m.end()))
    # base spans are candidates themselves, in place of what they overlap
    order = sorted((s, e, k + 1) for k, s, e in base)
    spans, i, reach = [], 0, 0
    ends = list(accumulate((e for _, e, _ in order), max))
    for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
        while i < len(order) and ends[i] <= s:
            i += 1
        if s >= reach and (i == len(order) or order[i][0] >= e):
            spans.append((s, e, 0))  # a key may hold what looks like a number
            reach = e
    nodes = sorted(spans + order)
    features = np.array([_features(text, s, e) for s, e, _ in nodes], dtype=np.float64).reshape(-1, N_FEATURES)
    edges, last = [], {}
    for j, (s, e, _) in enumerate(nodes):
        key = _key(text[s:e])
        if j and s - nodes[j - 1][1] <= NEAR:
            edges.append((j - 1, j, 0))
        if key in last:
            edges.append((last[key], j, 1))
        last[key] = j
    kinds = np.array([k for _, _, k in nodes], dtype=np.int64)
    signed = features[:, 20] > 0 if len(nodes) else np.zeros(0, dtype=bool)
    return Candidates([(s, e) for s, e, _ in nodes], features, kinds, np.where((kinds == 0) & signed, SECRET, kinds), np.array(edges, dtype=np.int64).reshape(-1, 3))


def bounded(c: Candidates, text: str, most: int) -> Candidates:
    """At most ``most`` of the candidates, those whose keys have the least digests."""
    if len(c.spans) <= most:
        return c
    digests = [xxhash.xxh64_intdigest(_key(text[s:e]).encode("utf-8", "surrogatepass")) for s, e in c.spans]
    keep = np.sort(np.lexsort((np.arange(len(digests)), np.array(digests, dtype=np.uint64)))[:most])
    place = np.full(len(digests), -1)
    place[keep] = np.arange(most)
    edges = np.stack((place[c.edges[:, 0]], place[c.edges[:, 1]], c.edges[:, 2]), axis=1)
    return Candidates([c.spans[i] for i in keep], c.features[keep], c.base[keep], c.labels[keep], edges[(edges[:, :2] >= 0).all(axis=1)])


@dataclass
class Field:
    """Log-potentials: ``unary`` (features x labels), ``pairs`` for chain and for skip
    edges (2 x labels x labels; that of skip edges is symmetric)."""

    unary: np.ndarray
    pairs: np.ndarray

    def marginals(self, c: Candidates) -> np.ndarray:
        """Probabilities of the labels of each candidate by loopy sum-product: chain and
        skip edges pass messages in all rounds at once, damped by half."""
        own = c.features @ self.unary
        fixed = c.base > 0
        own[fixed] = -50.0
        own[fixed, c.base[fixed]] = 0.0
        if len(c.edges):
            a, b, kind = c.edges.T
            source, target = np.concatenate((a, b)), np.concatenate((b, a))
            weight = np.concatenate((self.pairs[kind], self.pairs[kind].transpose(0, 2, 1)))
            message, back = np.zeros((len(source), own.shape[1])), np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
            for _ in range(ROUNDS):
                belief = own.copy()
                np.add.at(belief, target, message)
                new = np.logaddexp.reduce((belief[source] - message[back])[:, :, None] + weight, axis=1)
                new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
                moved = np.abs(new - message).max()
                message = 0.5 * message + 0.5 * new
                if moved < SETTLED:
                    break
            np.add.at(own, target, message)
        return np.exp(own - np.logaddexp.reduce(own, axis=1, keepdims=True))

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The base spans and those the field adds, by kind, then start."""
        c = candidates(text, base)
        if not len(c.base) or (c.base > 0).all():
            return base
        p = self.marginals(c)
        label = p.argmax(axis=1)
        more = [(int(label[j]) - 1, *c.spans[j]) for j in np.flatnonzero((c.base == 0) & (label > 0) & (p.max(axis=1) >= MARGINAL))]
        return sorted(base + more) if more else base


def _neighbours(labels: np.ndarray, edges: np.ndarray, n: int) -> np.ndarray:
    """(3, n, labels): of each candidate the labels of the one before it in the chain,
    of the one after it, and of those at its skip edges, counted."""
    out = np.zeros((3, n, len(LABELS)))
    a, b, kind = edges.T
    for to, at, of in ((0, b[kind == 0], a[kind == 0]), (1, a[kind == 0], b[kind == 0]), (2, b[kind == 1], a[kind == 1]), (2, a[kind == 1], b[kind == 1])):
        np.add.at(out[to], (at, labels[of]), 1)
    return out


def training_rows(c: Candidates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, neighbours, labels) for training: the candidates as they are, and of
    each with a label a mention without the sign: linked with the full one (its label),
    with nothing (none), and with another such (none, twice)."""
    near = _neighbours(c.labels, c.edges, len(c.labels))
    x, y, add = [c.features], [c.labels], [near]
    for i in np.flatnonzero(c.labels):
        k = int(c.labels[i])
        bare = c.features[i].copy()
        bare[list(SIGNS[k])] = 0
        if k in (2, 3, 4) and i % 2:  # a mention may be shortened, too
            bare[list(LENGTHS)], bare[SHORT] = 0, 1
        linked = np.zeros((3, 4, len(LABELS)))
        linked[2, 0, k] = 1
        linked[2, 2:, 0] = 1
        x.append(np.stack([bare] * 4))
        y.append(np.array([k, 0, 0, 0]))
        add.append(linked)
    return np.concatenate(x), np.concatenate(add, axis=1), np.concatenate(y)


def train(made: list[Candidates], steps: int = STEPS) -> Field:
    """The field whose pseudo-likelihood on the candidates is the greatest: weights of
    features and of edges by one ascent (Adam), with a decay."""
    n = len(LABELS)
    unary, chain, skip = np.zeros((N_FEATURES, n)), np.zeros((n, n)), np.zeros((n, n))
    made = [training_rows(c) for c in made if len(c.labels)]
    if made:
        x, near, y = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made], axis=1), np.concatenate([m[2] for m in made])
        # equal rows once, with their number
        rows, count = np.unique(np.concatenate((x, *near, y[:, None]), axis=1), axis=0, return_counts=True)
        x, near, goal = rows[:, :N_FEATURES], [rows[:, N_FEATURES + i * n : N_FEATURES + (i + 1) * n] for i in range(3)], np.eye(n)[rows[:, -1].astype(int)]
        w = (count / count.sum())[:, None]
        theta = np.zeros(N_FEATURES * n + 2 * n * n)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            unary, chain, skip = theta[: N_FEATURES * n].reshape(-1, n), *theta[N_FEATURES * n :].reshape(2, n, n)
            z = x @ unary + near[0] @ chain + near[1] @ chain.T + near[2] @ skip
            off = w * (goal - np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True)))
            both = near[2].T @ off
            slope = np.concatenate(((x.T @ off).ravel(), (near[0].T @ off + off.T @ near[1]).ravel(), (both + both.T).ravel() / 2)) - DECAY * theta
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        unary, chain, skip = theta[: N_FEATURES * n].reshape(-1, n), *theta[N_FEATURES * n :].reshape(2, n, n)
    return Field(unary, np.stack((chain, skip)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample: int = SAMPLE, most: int = MOST) -> Field:
    """A field trained on at most ``sample`` documents, the first by md5 of their ids
    (of several texts of one id the greatest), and ``most`` candidates of each, all of
    whose whole text is read."""
    rows = pick(docs, id=id_col, text=text_col)
    few = bounded_sample(rows, rows.select("id").distinct(), "id", sample)
    texts = few.groupBy("id").agg(F.max("text").alias("text")).where(F.col("text").rlike("[0-9@]")).select("text")

    def graphs(batches):
        for b in slices(batches):
            out = []
            for t in b.column("text").to_pylist():
                c = bounded(candidates(t, base_spans(t)), t, most)
                if len(c.spans):
                    out.append((c.features.astype(np.float32).tobytes(), c.labels.astype(np.int8).tobytes(), c.edges.astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in list(zip(*out)) or [()] * 3], names=["features", "labels", "edges"])

    got = sorted(tuple(map(bytes, r)) for r in texts.mapInArrow(graphs, "features binary, labels binary, edges binary").collect())
    made = []
    for features, labels, edges in got:
        y = np.frombuffer(labels, dtype=np.int8).astype(np.int64)
        made.append(Candidates([], np.frombuffer(features, dtype=np.float32).reshape(-1, N_FEATURES).astype(np.float64), y, y, np.frombuffer(edges, dtype=np.int32).reshape(-1, 3).astype(np.int64)))
    return train(made)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{LABELS[k + 1]}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans[,
    masked]) for each row of ``docs``: numbers and digest of the base spans, all spans,
    how many the field added, and how many there are. ``masked`` is the text with the
    label in place of each span.

    Whole texts are read. A null text is empty and has no spans; null ids and repeated
    rows are kept; an empty table gives no rows.
    """
    rows = pick(docs, id=id_col, text=text_col)
    names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans", *["masked"] * with_text]

    def found(batches):
        for b in slices(batches):
            out = []
            for text in b.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                every = field.spans(text, base)
                count = Counter(k for k, _, _ in base)
                row = [*(count[k] for k in range(len(KINDS))), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base), len(every)]
                if with_text:
                    at, parts = 0, []
                    for k, s, e in sorted(every, key=lambda x: x[1:]):
                        if s >= at:
                            parts += [text[at:s], f"[{LABELS[k + 1]}]"]
                        at = max(at, e)
                    row.append("".join([*parts, text[at:]]))
                out.append(row)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()] * with_text
            cols = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    schema = f"id {dict(rows.dtypes)['id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long" + ", masked string" * with_text
    return rows.mapInArrow(found, schema).withColumnRenamed("id", id_col)
