import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.llm import chat, pii, quality
from nearfield.llm.url_filter import MAX_BITS, RULES, Cascade, filter_urls, marked, with_listed
from tests.conftest import SF
from tests.llm.conftest import DOCS

CONTROL = st.sampled_from([*chat.CONTROL, "[\\INST]", "<\\/s>", "\\", "[", "<", "s>", "é\n", " ok "])


@settings(max_examples=300, deadline=None)
@given(st.lists(CONTROL | st.text(max_size=4), max_size=8).map("".join))
def test_escaping_is_reversible(text):
    assert not any(c in chat.escape(text) for c in chat.CONTROL)
    assert chat.unescape(chat.escape(text)) == text


@pytest.fixture(scope="module")
def ranks(spark):
    return chat.load_ranks(spark, chat.VOCABULARY)


@settings(max_examples=100, deadline=None)
@given(st.sampled_from(["user", "assistant", "system", "", "tool [ROLE]", "</s>"]), st.lists(CONTROL | st.text(max_size=6), max_size=6).map("".join))
def test_a_turn_reads_back(role, text):
    import base64

    codec = chat.Codec._made.get("test") or chat.Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, open(chat.VOCABULARY, "rb"))})
    chat.Codec._made["test"] = codec
    ids, mask = codec.turn(role, text)
    back = codec.parse(ids, mask)
    assert back[:3] == (role, text, text if role == "assistant" else "")
    assert sum(i >= codec.first for i in ids) == (2 if role in chat.TURN else 3) and len(ids) == len(mask)


def digests(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        mine = sorted(((t, r or "", x or "") for c, t, r, x in turns if c == conv), key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest()))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        out[conv] = (len(mine), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations_read_back(spark, ranks):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a"), (1, 2, None, None), (2, 0, "assistant", None), (None, 0, "tool", "x" * 130_000), (3, 5, "system", "be [\\INST] kind"), (3, 5, "system", "be [\\INST] kind"), (4, None, "user", "no turn"), (4, 0, "user", "after it")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").select("*", *[F.lit(1).alias(c) for c in ("ids", "mask", "role_order")])
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digest_chat(chat.format_chat(df, ranks), ranks).collect()}
    assert got == digests(turns)
    long = "x" * 130_000 + " " + "Ein langer Text, 12 times. " * 4000
    ids, mask = next((r["ids"], r["mask"]) for r in chat.format_chat(spark.createDataFrame([(1, 0, "assistant", long)], "conv_id long, turn long, role string, text string"), ranks).collect())
    encoding = chat.Codec(ranks[1].value).encoding
    assert ids[1:-1] == encoding.encode_ordinary(long) and mask == [0] + [1] * (len(ids) - 2) + [0]
    ordered = [(r["conv_id"], r["turn"]) for r in chat.in_order(chat.format_chat(df.where("conv_id = 1"), ranks)).collect()]
    assert ordered == [(1, 0), (1, 1), (1, 1), (1, 2)]
    assert chat.digest_chat(chat.format_chat(df.where("1 = 0"), ranks), ranks).count() == 0


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7x?q#f", "http://example.com/en/7", "http://com/en/1", "http://xcom/en/1", "a://b.net/de/1", "a://x.example.net/de/81", "s://example.org?x=/es/", "s://é.org/es/\n1", "s://a/b://c", "http://example.com/EN/7", "//x"]


def url_want(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), v, r) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits)[1:] if fits else None


@pytest.mark.parametrize("max_bits", [MAX_BITS, 256])
def test_urls(spark, max_bits):
    urls = URLS + [f"http://h{i % 50}.example.com/p/{i}" for i in range(400)] + URLS[:5]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").select("*", F.lit("z").alias("key"), F.lit("z").alias("host"), F.lit(1).alias("listed"))
    listed = {"h3.example.com/p/3", "xcom/en/1", "com/en/1", "not.here/x", *[f"h{i % 50}.example.com/p/{i}" for i in range(0, 400, 7)]}
    got = {r["page_id"]: r for r in filter_urls(df, spark.createDataFrame([(k,) for k in listed], "key string"), max_bits=max_bits).collect()}
    for i, u in enumerate(urls):
        host, path, rule = url_want(u)
        verdict = rule[0] if rule else "block" if host + path in listed else "allow"
        assert tuple(got[i]) == (i, host, path, rule and rule[1], verdict)
    assert filter_urls(df.where("1 = 0")).count() == 0


def test_a_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    cascade = Cascade.of(keys.where("id % 9 = 4"), keys)
    assert len(cascade.levels) > 2
    assert keys.where(cascade.is_listed(F.col("key")) != (F.col("id") % 9 == 4)).count() == 0
    assert Cascade.of(keys.where("id < 0"), keys).levels == []


def test_shards_are_exact_and_no_level_is_beyond_the_bound(spark, monkeypatch):
    sizes, words = [], Cascade._words
    monkeypatch.setattr(Cascade, "_words", staticmethod(lambda keys, level, hashes, bits: sizes.append(bits) or words(keys, level, hashes, bits)))
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    table = marked(keys.where("id % 5 = 4"), keys)
    got = with_listed(keys, table, 2000)
    assert got.count() == 3000 and got.where(F.col("listed") != (F.col("id") % 5 == 4)).count() == 0
    assert len(sizes) > 4 and max(sizes) <= 2000


def plain_spans(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return out


PIECES = st.sampled_from(["a@b.co", "@", ".", "a", "é", "1.2.3.4", "255", "256", "4111 1111 1111 1111", "4111111111111111", "+1 (679) 555-1339", "+", "0", "12", " ", "-", "(", "%+", "@x-.y", "٣"])


@settings(max_examples=500, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_spans_are_the_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_are_quick():
    for run in ("1" * 200_000, "a" * 200_000, "a@" * 50_000, "1." * 50_000, "+1" * 50_000, "1 " * 100_000):
        pii.base_spans(run)


@pytest.fixture(scope="module")
def field():
    """Trained on made texts, some with repeats, secrets, and numbers that are nothing."""
    texts = [f"call +1 (679) 555-{n:04d} or write a{n}@b.co from 10.0.0.{n % 256}, order {n * 7919 % 10**8:08d}, {n:04d}0000{n * 104729 % 10**8:08d}" for n in range(1000, 1200)]
    texts += [f'card 4111111111111111 and token = "{hashlib.sha1(b"%d" % n).hexdigest()}" of build {hashlib.sha1(b"x%d" % n).hexdigest()}' for n in range(100)]
    return pii.train([pii.candidates(t, pii.base_spans(t)) for t in texts])


def added(field, text):
    base = pii.base_spans(text)
    every = field.spans(text, base)
    assert set(base) <= set(every) and every == sorted(every)
    return [(pii.LABELS[k + 1], text[s:e]) for k, s, e in every if (k, s, e) not in base]


def test_skip_edges_find_what_is_repeated_in_another_form(field):
    far, key = " word" * 60 + " ", hashlib.sha1(b"k").hexdigest()
    assert added(field, "call +1 (679) 555-1339 today." + far + "again (679) 555-1339 please." + far + "order 83920174 shipped") == [("phone", "(679) 555-1339")]
    assert added(field, "from 10.11.22.34" + far + "and 10-11-22-34" + far + "not 10-11-22-35") == [("ip", "10-11-22-34")]
    assert added(field, "4111 1111 1111 1111" + far + "card 11111111 was charged" + far + "22222222") == [("card", "11111111")]
    assert added(field, "anna.b7@mail.example.com" + far + "anna.b7@ as before" + far + "otto.c9@ too") == [("email", "anna.b7@")]
    assert added(field, f'token = "{key}"' + far + f"see {key.upper()}" + far + hashlib.sha1(b"other").hexdigest()) == [("secret", key), ("secret", key.upper())]
    for clean in ("order 83920174 and version 2.0.1 of 2024-01-01 12:00", "order 83920174, again order 83920174", f"commit {key} and again {key}", "a@b and 7536784127813050", ""):
        assert added(field, clean) == []


def exact_marginals(field, c):
    """Over all labellings of the candidates that are not fixed."""
    n, total = len(pii.LABELS), np.zeros((len(c.base), len(pii.LABELS)))
    own = c.features @ field.unary
    for labelling in itertools.product(*[[int(k)] if k else range(n) for k in c.base]):
        w = sum(own[i, y] for i, y in enumerate(labelling) if not c.base[i]) + sum(field.pairs[k, labelling[a], labelling[b]] for a, b, k in c.edges)
        for i, y in enumerate(labelling):
            total[i, y] += np.exp(w)
    return total / total.sum(axis=1, keepdims=True)


def test_marginals_of_the_field(field):
    r = np.random.default_rng(8)
    n = len(pii.LABELS)
    for seed in range(12):  # any weights; trees are exact
        skip = r.standard_normal((n, n))
        any_field = pii.Field(r.standard_normal((pii.N_FEATURES, n)) * 0.5, np.stack((r.standard_normal((n, n)), skip + skip.T)))
        tree = np.array([(0, 1, 0), (1, 2, 0), (1, 4, 1), (2, 3, 1)])
        c = pii.Candidates([], r.integers(0, 2, (5, pii.N_FEATURES)).astype(float), np.array([0, 0, seed % n, 0, 0]), np.zeros(5, dtype=int), tree)
        assert np.allclose(any_field.marginals(c), exact_marginals(any_field, c), atol=1e-4)
    loop = pii.candidates("+1 (679) 555-1339, (679) 555-1339, 10-11-22-34, (679) 555-1339; 10-11-22-34", pii.base_spans("+1 (679) 555-1339"))
    assert len(loop.edges) > len(loop.base) - 1 and np.abs(field.marginals(loop) - exact_marginals(field, loop)).max() < 0.05


def plain_added(field, text):
    """Candidates by scanning and comparing all with all; labels from exact marginals."""
    base = plain_spans(text)
    found = [(m.start(), m.end()) for p in (pii._ADDRESS, pii._NUMBER, pii._OPAQUE) for m in p.finditer(text)]
    digits = lambda x: sum(c in "0123456789" for c in x)
    keep = lambda x: "@" in x or digits(x) >= 7 and (re.fullmatch(pii._NUMBER, x) or len(x) >= 16) or len(x) >= 16 and digits(x) > 0
    found = [(s, e) for s, e in found if keep(text[s:e]) and ("@" in text[s:e] or not re.fullmatch(pii._OPAQUE, text[s:e]) or re.search("[a-z]", text[s:e].lower()) or re.fullmatch(pii._NUMBER, text[s:e]))]
    free = sorted((s, -e) for s, e in found if not any(a < e and s < b for _, a, b in base))
    nodes = [(a, b, k + 1) for k, a, b in base]
    for s, e in free:
        if not any(a < -e and s < b for a, b, k in nodes if not k):
            nodes.append((s, -e, 0))
    nodes.sort()
    keys = [pii._key(text[s:e]) for s, e, _ in nodes]
    edges = [(i - 1, i, 0) for i in range(1, len(nodes)) if nodes[i][0] - nodes[i - 1][1] <= pii.NEAR]
    edges += [(i, j, 1) for j in range(len(nodes)) for i in range(j) if keys[i] == keys[j] and keys[j] not in keys[i + 1 : j]]
    c = pii.Candidates([], np.array([pii._features(text, s, e) for s, e, _ in nodes]).reshape(-1, pii.N_FEATURES), np.array([k for *_, k in nodes], dtype=int), None, np.array(edges, dtype=int).reshape(-1, 3))
    p = exact_marginals(field, c)
    return [(pii.LABELS[q.argmax()], text[s:e]) for q, (s, e, k) in zip(p, nodes) if not k and q.argmax() and q.max() >= pii.MARGINAL]


def test_spans_are_those_of_a_plain_field(field):
    r = random.Random(11)
    pieces = ["+1 (679) 555-1339", "(679) 555-1339", "anna.b7@mail.example.com", "anna.b7@", "10.11.22.34", "10-11-22-34", "7536784127813050", "4111111111111111", "11111111", 'token = "0123456789abcdef0123"', "0123456789abcdef0123", "2024-01-01 12:00", "x" * 90, "x" * 90, "x" * 90]
    some = 0
    for _ in range(60):
        text = ", ".join(r.choice(pieces) for _ in range(r.randint(1, 7)))
        want = plain_added(field, text)
        assert sorted(added(field, text)) == sorted(want), text
        some += len(want)
    assert some > 30


def test_a_long_text_teaches_a_bounded_number_of_candidates():
    text = " ; ".join(f"{n * 7919 % 10**8:08d}" for n in range(500)) + " 10.0.0.1" * 30
    whole = pii.candidates(text, pii.base_spans(text))
    few = pii.bounded(whole, text, 40)
    assert len(few.base) == 40 == len(few.features) and len(whole.base) > 40
    assert pii.bounded(whole, text, 10**6) is whole and (few.edges[:, :2] < 40).all()


def test_pii_of_messy_rows(spark, messy, empty):
    field = pii.fit(messy)
    got = pii.find_pii(messy, field, with_text=True).collect()
    assert len(got) == len(DOCS) and all(r["spans"] == "" for r in got)
    docs = spark.createDataFrame([(1, "é a@b.co 1.2.3.4"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.find_pii(docs, field, with_text=True).collect()}
    assert rows[1]["spans"] == "email:2:8,ip:9:16" and rows[1]["masked"] == "é [email] [ip]" and rows[1]["n_email"] == rows[1]["n_ip"] == 1
    assert rows[1]["base_sha256"] == hashlib.sha256(b"email:2:8,ip:9:16").hexdigest() and rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(empty, pii.fit(empty)).count() == 0


def test_marginals_are_those_of_all_labellings():
    r = np.random.default_rng(3)
    model = quality.Model(r.standard_normal(quality.N_FEATURES), tuple(r.standard_normal(4)))
    x = r.standard_normal((5, quality.N_FEATURES))
    own, pairs, total, good = x @ model.weights, np.array(model.pairs).reshape(2, 2), 0.0, np.zeros(5)
    for code in range(32):
        y = [code >> t & 1 for t in range(5)]
        w = np.exp(sum(own[t] * y[t] for t in range(5)) + sum(pairs[y[t - 1], y[t]] for t in range(1, 5)))
        total, good = total + w, good + w * np.array(y)
    assert np.allclose(model.marginals(x), good / total)


def test_training_reads_a_bounded_part_of_a_document(spark, monkeypatch):
    assert quality.chains(128).tolist() == list(range(128)) and quality.chains(0).tolist() == []
    assert quality.chains(1000).tolist() == [*range(64), *range(936, 1000)]
    seen = []
    monkeypatch.setattr(quality, "train", lambda docs: seen.append([len(n) for _, _, n in docs]))
    docs = spark.createDataFrame([(i // 4, "line\n" * (i * 100) + f"{i}") for i in range(12)] + [(2, None)], "doc_id long, text string")
    quality.fit(docs, spark.createDataFrame([(0, 1), (2, 0), (2, None), (1, 1)], "doc_id long, quality int"))
    assert len(seen[0]) == sum(zlib.crc32(b"%d" % i) % 3 != 1 for i in range(3)) and all(n <= 128 for n in seen[0])


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_quality_ignores_held_out_labels_and_other_columns(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x"))
    a, b = ({r["doc_id"]: r["score"] for r in quality.classify(d, t).collect()} for d, t in ((docs, labels), (other, turned)))
    assert a == b


def test_quality_of_messy_rows(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, None), (None, 1), (6, 1), (7, 0), (8, 0), (10, 0)], "doc_id long, quality int")
    got = quality.classify(messy, labels).collect()
    assert len(got) == len(DOCS) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4)}) == 1
    assert quality.classify(empty, labels).count() == 0
    assert {r["predicted"] for r in quality.classify(messy, labels.where("1 = 0")).collect()} == {1}
    assert Counter(r["doc_id"] for r in got)[6] == 2
