import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearfield.llm.mixing import mix, targets
from nearfield.llm.packing import CAPACITIES, OVERHEAD, pack, plan_bins
from nearfield.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.llm.conftest import DOCS


def filled(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    """The targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, fixed = share * sum(sizes.values()), {}
    while len(fixed) < len(sizes):
        rest = [s for s in sizes if s not in fixed]
        part = {s: (budget - sum(fixed.values())) * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if part[s] > repeats * sizes[s]]
        if not over:
            return fixed | part
        fixed |= {s: float(repeats * sizes[s]) for s in over}
    return fixed


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {None if i == 2 else f"s{i}": r.choice([0, 1, 30, 1000, r.randint(1, 9999)]) for i in range(r.randint(1, 12))}
    got = {x["source"]: x["target"] for x in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = filled(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_mix_comes_near_its_targets(spark):
    r = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(["w"] * r.randint(0, 40)), r.choice("aaaaaaabc")) for i in range(1500)], "doc_id long, text string, source string")
    a, b = (mix(d).collect() for d in (docs, docs.repartition(7)))
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))
    taken, goal, most = defaultdict(int), {}, max(x["size"] for x in a)
    for x in a:
        taken[x["source"]] += x["taken"]
        goal[x["source"]] = x["target"]
        assert x["taken"] in (0, x["size"], 2 * x["size"])
    assert all(abs(taken[s] - goal[s]) <= 2 * most for s in goal) and sum(taken.values()) <= 1.5 * sum(x["size"] for x in a)


def test_mix_messy(messy, empty):
    got = mix(messy).collect()
    assert len(got) == len(DOCS) and all(x["taken"] <= 2 * x["size"] and x["target"] >= 0 for x in got)
    assert {x["size"] for x in got if x["doc_id"] in (3, 4, 9)} == {0}
    assert mix(empty).count() == 0


def plan_one_by_one(lengths):
    """The same rule, bin by bin on single pieces."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        best = None
        for c in sorted(CAPACITIES):
            if c < left[0]:
                continue
            room, held = c, []
            for n in left:
                if n <= room:
                    held.append(n)
                    room -= n
            if best is None or (c + OVERHEAD) / (c - room) <= best[0]:
                best = (c + OVERHEAD) / (c - room), held
        for n in best[1]:
            left.remove(n)
        out.append((next(c for c in sorted(CAPACITIES) if c >= sum(best[1])), best[1]))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_the_plan_is_that_of_single_pieces(seed):
    r = random.Random(seed)
    lengths = [r.choice([r.randint(1, 4095), r.randint(1, 300), 700]) for _ in range(200)]
    bins = plan_one_by_one(lengths)
    plan = plan_bins(Counter(lengths))
    made = Counter()
    for times, c, held in plan:
        made[c, tuple(n for n, t in held for _ in range(t))] += times
    assert Counter((c, tuple(held)) for c, held in bins) == made
    assert sum(c for c, _ in bins) < 1.05 * sum(lengths) + max(CAPACITIES)


def check_packed(rows, words):
    by_bin, by_doc = defaultdict(list), defaultdict(list)
    for x in rows:
        if x["bin_id"] is not None:
            by_bin[x["bin_id"], x["bin_capacity"]].append((x["bin_offset"], x["length"]))
            by_doc[x["doc_id"]].append((x["first"], x["length"]))
    assert sorted(b for b, _ in by_bin) == list(range(len(by_bin)))
    for (_, capacity), held in by_bin.items():
        at = 0
        for offset, n in sorted(held):
            assert offset == at and n > 0
            at += n
        assert at <= capacity and capacity == min(c for c in CAPACITIES if c >= at)
    for i, n in words.items():
        at = 0
        for first, length in sorted(by_doc[i]):
            assert first == at
            at += length
        assert at == n
    return by_bin


def test_packing(spark):
    r = random.Random(2)
    words = {i: r.choice([0, r.randint(1, 90), r.randint(1, 3000), r.randint(4000, 20_000), 250, 250]) for i in range(300)}
    docs = spark.createDataFrame(list(words.items()), "doc_id long, n long")
    a, b = (pack(d, length_col="n").collect() for d in (docs, docs.repartition(5)))
    bins = check_packed(a, words)
    assert Counter(map(tuple, a)) == Counter(map(tuple, b)) and len({x["doc_id"] for x in a}) == 300
    assert sum(c for _, c in bins) < 1.05 * sum(words.values())


def test_packing_messy(messy, empty):
    rows = pack(messy).collect()
    check_packed(rows, {7: 9001, 3: 0, 1: 8})
    assert sum(x["length"] for x in rows) == sum(len((t or "").encode().split()) for _, t, *_ in DOCS)
    assert pack(empty).count() == 0


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, same, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        same(got, duck.execute(ORACLES[name]).df())
    else:
        assert len(got) >= 200


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).localCheckpoint())  # of a test, on one machine
    good, exact, near, mixed, packed = seen[1:]
    assert all(d.columns == docs.columns for d in seen[:-1])
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    assert len(bad & kept) <= 1 and kept >= {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()} - {r["doc_id"] for r in docs.where("text is null").collect()} - (bad | {None}) or len(kept) > 100
    texts = [r["t"] for r in exact.select(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("t")).collect()]
    assert len(texts) == len(set(texts)) and near.count() <= exact.count()
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert max(times.values()) <= 2 and set(times) <= {r["doc_id"] for r in near.collect()}
    assert packed.agg(F.sum("length")).first()[0] == sum(len(r["text"].encode().split()) for r in mixed.collect())


def test_a_mix_cut_at_a_hot_source(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "hot" if i % 3 else f"s{i % 9}") for i in range(600)], "doc_id long, text string, source string")
    got = mix(docs, share=0.4).collect()
    total = sum(x["size"] for x in got)
    assert 0.4 * total - 10 < sum(x["taken"] for x in got) <= 0.4 * total


def test_null_and_extra_columns_are_no_trouble(messy):
    assert pack(messy.withColumn("bin_id", F.lit(1))).count() == pack(messy).count()


def staged(frame):
    """As a stage gets its docs."""
    return frame.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def rows(frame):
    return Counter(map(tuple, frame.collect()))


def test_exact_stage_decides_by_row(spark, messy, empty):
    more = [(20, "ex", "en", "a"), (20, "why", "en", "a"), (21, "ex", "en", "a"), (None, "no ID here", "en", "a"), (None, "twice", "en", "a"), (None, "Twice", "en", "a")]
    docs = staged(messy).unionByName(staged(spark.createDataFrame(more, "doc_id long, text string, lang string, source string")))
    given, got = rows(docs), rows(corpus_pipeline.exact(spark, docs, SF))
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    best = defaultdict(lambda: -1)
    for i, t, *_ in given:
        best[low(t)] = max(best[low(t)], -1 if i is None else i)
    assert not got - given
    assert Counter((low(t), -1 if i is None else i) for i, t, *_ in got.elements()) == Counter(best.items())
    assert corpus_pipeline.exact(spark, staged(empty), SF).count() == 0


def test_mixing_stage_repeats_each_row_by_its_own_passes(spark, messy, empty):
    more = [(30, "w " * k, "en", "a") for k in (3, 5, 5, 7)] + [(None, "x " * k, "fr", "d") for k in (2, 4, 400)]
    docs = staged(messy).unionByName(staged(spark.createDataFrame(more, "doc_id long, text string, lang string, source string")))
    size = lambda t: len((t or "").encode().split())
    want = Counter()
    for x in mix(docs).collect():
        want[x["doc_id"], x["source"], x["size"]] += x["passes"] if x["size"] else 1
    got = rows(corpus_pipeline.mixing(spark, docs, SF))
    assert Counter((i, s, size(t)) for i, t, _, s, _ in got.elements()) == +want
    assert any(i is None and t for i, t, *_ in got) and not set(got) - set(rows(docs))
    assert corpus_pipeline.mixing(spark, staged(empty), SF).count() == 0


def test_names_of_rows_of_files(spark, messy, tmp_path):
    staged(messy).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    named = corpus_pipeline._named(docs)
    assert named.select("_row").distinct().count() == len(DOCS) and {r["_row"]["at"] for r in named.collect()} <= set(range(len(DOCS)))
    for stage in (corpus_pipeline.exact, corpus_pipeline.mixing):
        a, b = rows(stage(spark, docs, SF)), rows(stage(spark, staged(messy), SF))
        assert Counter((i, t, s) for i, t, _, s, _ in a.elements()) == Counter((i, t, s) for i, t, _, s, _ in b.elements())
    twice = docs.union(docs)  # no plain table: rows of one file and place are two
    assert corpus_pipeline._named(twice).select("_row").distinct().count() == 2 * len(DOCS)


def test_other_stages_on_messy_rows(spark, messy, empty):
    docs = staged(messy)
    good = rows(corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.001"))
    assert not good - rows(docs)
    near = Counter(i for i, *_ in rows(corpus_pipeline.near(spark, docs, SF)).elements())
    assert near[6] == 2 and near[7] == 0 and near[None] == 2 and near[1] + near[2] == 1
    check_packed(corpus_pipeline.packing(spark, docs, SF).collect(), {7: 9001, 3: 0, 1: 8})
    kept = Counter(i for i, *_ in good.elements())
    assert kept[6] in (0, 2) and all(n <= 2 for n in kept.values())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, staged(empty), "/root/testdata/sf0.001").count() == 0
