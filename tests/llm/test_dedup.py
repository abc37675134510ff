import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from nearfield.llm import simhash, substring_dedup as sub
from nearfield.llm.embedding_dedup import embedding_dedup
from nearfield.llm.exact_dedup import exact_dedup
from nearfield.sources import shared
from tests.llm.conftest import DOCS, SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def some_texts(n, seed):
    """Texts that share passages, copies, near copies and frequent words."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    passages = [[r.choice(words) for _ in range(r.randint(5, 25))] for _ in range(6)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.3:
            t = r.choice(out).split(" ")
            if r.random() < 0.6 and len(t) > 3:
                t[r.randrange(len(t))] = r.choice(words)
        else:
            t = []
            for _ in range(r.randint(0, 5)):
                t += r.choice(passages) if r.random() < 0.5 else [r.choice(words) for _ in range(r.randint(1, 15))]
        out.append(" ".join(t))
    return out


def removed_words(rows, window):
    first, out = {}, {}
    for i, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = set()
        for s in range(len(words) - window + 1):
            k = tuple(words[s : s + window])
            if first.setdefault(k, i) < i:
                gone.update(range(s, s + window))
        out[i] = (len(words), len(gone), hashlib.sha256(" ".join(w for j, w in enumerate(words) if j not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed,window,gram", [(1, 6, 2), (2, 8, 4), (3, 5, 5)])
def test_substring_dedup_is_brute_force(spark, seed, window, gram):
    rows = list(enumerate(some_texts(150, seed)))
    got = sub.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=window, gram=gram, with_text=True).collect()
    want = removed_words(rows, window)
    assert sum(w[1] for w in want.values()) > 100
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_substring_dedup_of_messy_rows(messy, empty):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in sub.substring_dedup(messy).collect())
    want = Counter({(6, 9000, 0): 2, (7, 9001, 9000): 1, (3, 0, 0): 1, (None, 0, 0): 1, (None, 3, 0): 1, (9, 0, 0): 1, (10, 1, 0): 1})
    assert sum(got.values()) == len(DOCS) and not want - got
    assert sub.substring_dedup(empty).count() == 0


def test_a_window_may_not_be_too_wide(messy):
    with pytest.raises(ValueError):
        sub.substring_dedup(messy, window=80, gram=5)


def exact_want(docs):
    groups = defaultdict(list)
    for i, t, *_ in docs:
        groups[lower(t)].append(i)
    keep = {t: max(g, key=lambda i: (i is not None, i)) for t, g in groups.items()}
    return Counter((i, keep[lower(t)], len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, *_ in docs), len(groups)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 7}, {"block_bytes": 5, "key_bits": 3}])
def test_exact_dedup(spark, messy, empty, options):
    docs = [(i, t) for i, t, *_ in DOCS if len(t or "") < 1000] + [(100 + i, t) for i, t in enumerate(some_texts(40, 5))]
    got = exact_dedup(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect()
    want, groups = exact_want(docs)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == groups and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_of_messy_rows(messy, empty):
    got = exact_dedup(messy, block_bytes=1000).collect()
    want, groups = exact_want(DOCS)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want and sum(r["kept"] for r in got) == groups
    assert exact_dedup(empty).count() == 0


def fingerprint(text, width=3):
    words = WORD.findall(lower(text))
    shingles = [" ".join(words[j : j + width]) for j in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_simhash_is_brute_force(spark):
    texts = [t for t in some_texts(120, 8)]
    long = " ".join(f"v{i}" for i in range(400))
    texts += [long + f" x{i}" for i in range(30)] + [long.replace("v7 ", f"y{i} ") for i in range(30)] + ["", None, "One", "one", "a b", "\x0b"]
    rows = list(enumerate(texts))
    prints = {i: fingerprint(t) for i, t in rows}
    root = reach(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}
    assert len(set(root.values())) < len(root) - 10


def test_links_within_two_bits_only(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(20)] + [0, 2**64 - 1]
    fps = {b for x in base for b in (x, x ^ 1 << r.randrange(64), x ^ 1 << r.randrange(64) ^ 1 << r.randrange(64), x ^ 0b111 << r.randrange(60))}
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    links = [(e["u"] & 2**64 - 1, e["v"] & 2**64 - 1) for e in simhash.hamming_links(frame).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    assert reach(fps, links) == reach(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])


def test_small_tables_have_few_files(spark, monkeypatch):
    import nearfield.operators.components as graph

    files = []

    def counted(df, *parts, **options):
        out = shared.materialize(df, *parts, **options)
        files.append(len(out.inputFiles()))
        return out

    for module in (simhash, graph):
        monkeypatch.setattr(module, "materialize", counted)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    texts = some_texts(120, 8) + [" ".join(f"v{i}" for i in range(400)) + f" x{i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    prints = {i: fingerprint(t) for i, t in enumerate(texts)}
    assert got == reach(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    assert len(files) > 8 and max(files) <= docs.rdd.getNumPartitions()


def test_simhash_of_messy_rows(messy, empty):
    got = simhash.simhash_components(messy).collect()
    assert len(got) == len(DOCS)
    assert {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {3}
    assert Counter(r["doc_id"] for r in got)[6] == 2
    assert simhash.simhash_components(empty).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_duplicates_by_similarity(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_PART", 7)
    r = random.Random(6)
    bases = [[f"b{k}w{r.randrange(500)}" for _ in range(r.randint(60, 300))] for k in range(4)]
    texts = []
    for b in bases:
        texts.append(" ".join(b))
        for edits in (1, 1, 2, 3, 4, 6, 9, 14, 25):
            t = list(b)
            for _ in range(edits):
                t[r.randrange(len(t))] = f"e{r.random()}"
            texts.append(" ".join(t))
    texts += ["", "", "one", "two words"]
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for i, t in enumerate(texts) if (w := t.split())}
    root = reach(range(len(texts)), [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8])
    got = {x["id"]: x["component_id"] for x in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    missed = [i for i in root if root[i] != i and got.get(i, i) == i]
    false = [i for i in got if sets.get(i) and got[i] != i and root[i] != root[got[i]]]
    assert not false and len(missed) <= 1 and sum(root[i] != i for i in root) > 15


@pytest.mark.parametrize("part", [200, 4])
def test_every_group_is_searched_fully(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "GROUP_PART", part)
    monkeypatch.setattr(simhash, "SAMPLES", 2)
    monkeypatch.setattr(simhash, "SAMPLE_SIZE", 1)
    r = random.Random(9)
    texts = []
    for k in range(3):
        base = [f"b{k}w{i}" for i in range(150)]
        for _ in range(8):  # variants that are no near copies of each other, and near copies of each
            variant = [w if r.random() < 0.95 else f"v{r.random()}" for w in base]
            for _ in range(r.randint(1, 6)):
                texts.append(" ".join(w if r.random() < 0.01 else f"e{r.random()}" if r.random() < 0.012 else w for w in variant))
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met = defaultdict(list)
    for x in simhash._samples(docs, "doc_id", "text", 5).collect():
        for at, fp in enumerate(x["fps"]):
            met[at, fp].append(x["id"])
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for w in map(str.split, texts)]
    linked = {(a, b) for ids in met.values() for a in ids for b in ids if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    root = reach(range(len(texts)), linked)
    got = {x["id"]: x["component_id"] for x in simhash.near_duplicates(docs).collect()}
    assert {i: got.get(i, i) for i in root} == root and any(len(ids) > 15 for ids in met.values())
    heads = reach(range(len(texts)), {(min(ids), b) for ids in met.values() for b in ids if jaccard(sets[min(ids)], sets[b]) >= 0.8})
    assert heads != root  # the first documents alone do not find them


def test_near_duplicates_of_short_texts_are_brute_force(spark):
    r = random.Random(12)
    texts = []
    for k in range(70):
        words = [f"s{k}w{i}" for i in range(r.randint(5, 20))]
        if k % 3 == 0:
            words = "a line that many of them have".split() + words
        more = words + [f"t{k}"]
        texts += [" ".join(words), " ".join(more), " ".join(more[2:]), " ".join([f"u{k}", f"x{k}", *words])]
    texts += ["a b c d e f g h", "a b c d e f g h i", "one", "ONE", "one two", "", None]
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for i, t in enumerate(texts) if (w := (t or "").lower().split())}
    root = reach(range(len(texts)), [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8] + [(len(texts) - 2, len(texts) - 1)])
    got = {x["id"]: x["component_id"] for x in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i: got.get(i, i) for i in root} == root and sum(root[i] != i for i in root) > 60


def test_near_duplicates_take_fingerprints_within_two_bits(spark, monkeypatch):
    plain = simhash._samples

    def blind(docs, *columns):  # no two rows share a sample
        other = "concat(transform(slice(fps, 1, size(fps) - 1), (x, i) -> xxhash64(id, i)), slice(fps, -1, 1))"
        return plain(docs, *columns).selectExpr("id", "n", f"{other} fps", "few")

    monkeypatch.setattr(simhash, "_samples", blind)
    texts = []
    for k in range(6):
        base = [f"b{k}w{i}" for i in range(400)]
        texts += [" ".join([*base, f"e{k}x{j}"]) for j in range(6)]
    loud = " ".join("a b c d e f g".split() * 60)  # one fingerprint, few common shingles
    texts += [" ".join([loud, *(f"t{k}x{i}" for i in range(70))]) for k in range(3)]
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for w in map(str.split, texts)]
    prints, ids = [fingerprint(t, 5) for t in texts], range(len(texts))

    def want(bits):
        chain = reach(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= bits])
        return reach(ids, [(a, b) for a in ids for b in ids if a < b and chain[a] == chain[b] and jaccard(sets[a], sets[b]) >= 0.8]), chain

    root, chain = want(2)
    got = {x["id"]: x["component_id"] for x in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i: got.get(i, i) for i in ids} == root
    assert want(0)[0] != root and any(chain[i] != i and root[i] == i for i in ids)


def test_near_dedup_keeps_columns_and_rows(messy, empty):
    out = simhash.near_dedup(messy)
    assert out.columns == messy.columns
    ids = Counter(r["doc_id"] for r in out.collect())
    assert ids[6] == 2 and ids[7] == 0 and ids[None] == 2 and ids[1] + ids[2] == 1
    assert simhash.near_dedup(empty).count() == 0


def vector_want(rows, threshold=0.98):
    unit = {}
    for i, v, label in rows:
        if label is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v):
            unit[i] = (label, np.array(v) / np.linalg.norm(v))
    linked = [(a, b) for a in unit for b in unit if a != b and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= threshold]
    root, count = reach([r[0] for r in rows], linked), Counter(a for a, _ in linked)
    return {i: (count[i], root[i], root[i] == i) for i, _, _ in rows}


@pytest.mark.parametrize("part", [512, 5])
def test_embeddings_are_brute_force(spark, part):
    r = np.random.default_rng(2)
    centers = r.standard_normal((12, 24))
    rows = []
    for i in range(160):
        v = centers[i % 12] + r.standard_normal(24) * r.choice([0.0, 0.05, 0.12, 0.3])
        rows.append((i, (v * r.choice([1.0, 2.0])).tolist(), int(i % 3 % 2)))
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [None] + [1.0] * 23, 1), (904, rows[0][1], None), (905, [1e300, 1e300], 1), (906, [1.0, 1.0], 1), (907, [], 1), (908, [-0.0, 1.0], 1), (909, [0.0, 1.0], 1), (910, [float("inf")], 1)]
    got = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), part=part).collect()
    want = vector_want([(i, v if i != 905 else [1.0, 1.0], label) for i, v, label in rows])
    assert {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in got} == want
    assert sum(w[0] for w in want.values()) > 300


def test_embeddings_of_several_lengths_are_brute_force(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(600):
        d = 3 + i % 3
        v = np.eye(d)[i // 200 % d] * 5 + r.standard_normal(d) * 0.3
        rows.append((i, v.tolist(), 1))
    got = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = vector_want(rows)
    assert sum(w[0] for w in want.values()) > 10_000
    # few dimensions leave a pair near the threshold a chance to meet nowhere
    counted = {x["vec_id"]: x["n_links"] for x in got}
    assert sum(counted.values()) >= 0.99 * sum(w[0] for w in want.values()) and all(counted[i] <= want[i][0] for i in want)
    assert {x["vec_id"]: x["component_id"] for x in got} == {i: w[1] for i, w in want.items()}


def test_embeddings_messy(spark):
    from pyspark.sql import functions as F

    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", *[F.lit(0).alias(c) for c in ("id", "class", "name", "n", "unit", "vec")])
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup(df).collect())
    assert got == Counter({(1, 2, 1): 2, (None, 2, 1): 1, (2, 0, 2): 1})
    assert embedding_dedup(df.where("1 = 0")).count() == 0


def test_schema_is_as_given(spark):
    assert spark.createDataFrame(DOCS, SCHEMA).count() == len(DOCS)
