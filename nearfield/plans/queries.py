"""The queries over the tables at hand, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.hashing import fingerprint, hash32
from nearfield.operators import candidates as cand
from nearfield.operators import classify, cluster, exact, graph, index
from nearfield.operators.index import sampled
from nearfield.operators.signature import long_signatures, minhash_sql, signatures
from nearfield.plans import sql
from nearfield.plans.model import MinHash, WtaHash
from nearfield.plans.presets import PRESETS
from nearfield.sources import datasets
from nearfield.sources.rows import from_csr, read_matrix_market, to_long
from nearfield.sources.shared import materialize, shared_dir
from nearfield.streaming import ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
H, CAP, K, EXCESS = 32, 50, 5, 5
#: A winner is one of WTA_K, so two slots make a value, of WTA_K squared.
WTA_K, WTA_SLOTS = 8, H // 2
#: Models of the last query, whose tables the executors keep until the next begins.
_open: list = []


def query(oracle: str | None = None):
    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            while _open:
                _open.pop().close()
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return run

    return add


def _kept(model):
    _open.append(model)
    return model


def _minhash(**options) -> MinHash:
    return _kept(MinHash(**{"number_of_hash_functions": H, "max_bin_size": CAP, "n_neighbors": K, "excess_factor": EXCESS, "precision": 6, **options}))


def _wta(**options) -> WtaHash:
    shingles = {"shingle": 1, "block_size": 1, "shingle_size": 2}
    return _kept(WtaHash(**{"number_of_hash_functions": H, "max_bin_size": CAP, "rangeK_wta": WTA_K, "n_neighbors": K, "excess_factor": EXCESS, "precision": 6, **shingles, **options}))


def _signed(spark, sf_dir, build=datasets.baskets) -> DataFrame:
    return long_signatures(signatures(build(spark, sf_dir), H))


# hashes and signatures


@query(sql.with_(sql.data("baskets"), ("k", f"SELECT id, f, ((f + 1) * 7) & {sql.M} AS k, {sql.MIX} FROM x"), final="SELECT id, f, h FROM k"))
def wang_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(datasets.baskets(spark, sf_dir)).select("id", "f", hash32(F.col("f") + 1, 7).alias("h"))


@query(sql.with_(sql.data("baskets"), *sql.minhash(H), final="SELECT * FROM s"))
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(spark, sf_dir)


@query(sql.with_(sql.data("tokens"), *sql.minhash(H), final="SELECT * FROM s"))
def minhash_signature_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(spark, sf_dir, datasets.tokens)


@query(sql.with_(sql.data("baskets"), *sql.minhash(H), final="SELECT * FROM s"))
def minhash_signature_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_sql(datasets.baskets(spark, sf_dir), H)


_STEP = sql.hash_text("f + 1", "s + 1")


@query(sql.with_(sql.data("baskets"), final=f"SELECT id, list_reduce(list_prepend(CAST(0 AS BIGINT), list(f ORDER BY f)), lambda s, f: {_STEP}) AS fingerprint FROM x GROUP BY id"))
def signature_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.baskets(spark, sf_dir).select("id", fingerprint(F.col("features")).alias("fingerprint"))


@query(sql.with_(
    sql.data("baskets"), *sql.minhash(20),
    ("l", "SELECT id, list(val ORDER BY slot) AS raw FROM s GROUP BY id"),
    final=f"SELECT id, CAST(b AS INTEGER) AS slot, list_reduce(list_slice(raw, b * 3 + 1, b * 3 + 3), lambda s, f: {_STEP}) AS val FROM l, range(7) AS r(b)",
))
def shingle_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_signatures(signatures(datasets.baskets(spark, sf_dir), 10, block_size=2, shingle=1, shingle_size=3))


@query(sql.with_(sql.data("embeddings"), *sql.wta(H, WTA_K), final="SELECT * FROM s"))
def wta_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_signatures(signatures(datasets.embeddings(spark, sf_dir), H, algorithm="wta", range_k=WTA_K)).where("val <> 0")


@query(sql.with_(sql.data("baskets"), *sql.wta(8, 20), final="SELECT * FROM s"))
def wta_signature_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_signatures(signatures(datasets.baskets(spark, sf_dir), 8, algorithm="wta", range_k=20)).where("val <> 0")


# the index


@query(sql.with_(sql.data("baskets"), *sql.minhash(H), final=f"SELECT * FROM s WHERE val & 1 = 0 AND val <> 0 AND val <> {sql.M}"))
def lsb_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(_signed(spark, sf_dir), 1)


@query(sql.with_(sql.data("tokens"), *sql.minhash(H), *sql.index(CAP), final="SELECT * FROM i"))
def index_bucket_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build_index(_signed(spark, sf_dir, datasets.tokens), CAP)


@query(sql.with_(sql.data("baskets"), *sql.minhash(H), *sql.index(CAP, prune=2), final="SELECT * FROM i"))
def index_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build_index(_signed(spark, sf_dir), CAP, prune=2)


@query(sql.with_(sql.data("tokens"), *sql.minhash(H), *sql.index(CAP, less=100), final="SELECT * FROM i"))
def slot_removal_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build_index(_signed(spark, sf_dir, datasets.tokens), CAP, less_entries=100)


@query(sql.with_(sql.data("tokens"), *sql.minhash(H), *sql.index(CAP, less=0), final="SELECT * FROM i"))
def slot_removal_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build_index(_signed(spark, sf_dir, datasets.tokens), CAP, less_entries=0)


_SIZES = ("z", "SELECT slot, val, count(*) AS n FROM i GROUP BY slot, val")


@query(sql.with_(sql.data("baskets"), *sql.minhash(H), *sql.index(CAP), _SIZES, final="SELECT n AS bucket_size, count(*) AS n FROM z GROUP BY z.n"))
def index_distribution_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash().fit(datasets.baskets(spark, sf_dir)).get_distribution_of_inverse_index()[0]


@query(sql.with_(sql.data("baskets"), *sql.minhash(H), *sql.index(CAP), _SIZES, final="SELECT slot, count(*) AS n_values, CAST(sum(n) AS BIGINT) AS sum_size, round(avg(n), 6) AS mean_size, round(stddev_pop(n), 6) AS std_size FROM z GROUP BY slot"))
def index_distribution_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_slot = _minhash().fit(datasets.baskets(spark, sf_dir)).get_distribution_of_inverse_index()[1]
    return per_slot.select("slot", "n_values", "sum_size", F.round("mean_size", 6).alias("mean_size"), F.round("std_size", 6).alias("std_size"))


@query(sql.with_(sql.data("baskets"), *sql.minhash(H), *sql.index(CAP), _SIZES, ("y", "SELECT count(*) AS n FROM z GROUP BY slot"), final="SELECT round(avg(n), 6) AS mean_values, round(stddev_pop(n), 6) AS std_values FROM y"))
def index_distribution_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _minhash().fit(datasets.baskets(spark, sf_dir)).get_distribution_of_inverse_index()[2]
    return total.select(F.round("mean_values", 6).alias("mean_values"), F.round("std_values", 6).alias("std_values"))


# candidates

_FAST = f"SELECT id, rank, neighbor_id, 1 - cnt / {float(H)}::DOUBLE AS distance FROM t"


def _fast(name: str, *more, k: int = K) -> str:
    return sql.with_(sql.data(name), *sql.minhash(H), *sql.index(CAP), *(more or sql.collisions()), *sql.top(k), final=_FAST)


@query(_fast("baskets"))
def candidates_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash().fit(datasets.baskets(spark, sf_dir)).kneighbors(fast=True)


@query(_fast("tokens"))
def candidates_fast_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash().fit(datasets.tokens(spark, sf_dir)).kneighbors(fast=True)


@query(_fast("baskets").replace("1 - cnt / 32.0::DOUBLE", "CAST(cnt AS DOUBLE)"))
def candidates_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash().fit(datasets.baskets(spark, sf_dir)).kneighbors(fast=True, pAbsoluteNumbers=True)


@query(_fast("tokens", *sql.collisions(8)))
def candidates_min_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash(minimal_blocks_in_common=8).fit(datasets.tokens(spark, sf_dir)).kneighbors(fast=True)


@query(sql.with_(sql.data("tokens"), *sql.minhash(H), *sql.index(CAP), *sql.collisions(), final=f"SELECT id, neighbor_id, cnt, CAST(rank() OVER (PARTITION BY id ORDER BY cnt DESC) AS INTEGER) AS rank FROM c QUALIFY rank <= {K}"))
def candidates_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _minhash().fit(datasets.tokens(spark, sf_dir))
    return cand.ranked(model.index, K, ties=True)


_HALVES = [("xo", "SELECT * FROM xa WHERE id % 2 = 1"), ("x", "SELECT * FROM xa WHERE id % 2 = 0")]


@query(sql.with_(("xa", sql.DATA["baskets"]), *_HALVES, *sql.minhash(H), *sql.index(CAP), *sql.minhash(H, "xo", "q"), *sql.collisions(queries="q"), *sql.top(K), final=_FAST))
def query_set_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datasets.baskets(spark, sf_dir)
    return _minhash().fit(rows.where("id % 2 = 0")).kneighbors(rows.where("id % 2 = 1"), fast=True)


@query(_fast("baskets"))
def partial_fit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datasets.baskets(spark, sf_dir)
    return _minhash().fit(rows.where("id % 2 = 0")).partial_fit(rows.where("id % 2 = 1")).kneighbors(fast=True)


@query(_fast("baskets"))
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(datasets.baskets(spark, sf_dir))
    arriving = rows.inputFiles()[0].rsplit("/", 1)[0]
    path = arriving + "-stream"
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(arriving)
    ingest.ingest(stream, _minhash(), path, f"{path}/checkpoint").awaitTermination()
    return ingest.stored(spark, _minhash(), path).kneighbors(fast=True)


@query(_fast("baskets"))
def saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/nearfield-model-{spark.sparkContext.applicationId}-{sf_dir.rstrip('/').rsplit('/', 1)[-1]}"
    _minhash().fit(datasets.baskets(spark, sf_dir)).save(path)
    return _kept(MinHash.load(spark, path)).kneighbors(fast=True)


#: Slots without a positive value are 0, and part of their shingle.
_TO_WTA = [
    sql.data("embeddings"), *sql.wta(H, WTA_K, "x", "r"),
    ("rz", f"SELECT i.id, list(coalesce(r.val, 0) ORDER BY n.slot) AS raw FROM (SELECT DISTINCT id FROM x) i CROSS JOIN range({H}) AS n(slot) LEFT JOIN r ON r.id = i.id AND r.slot = n.slot GROUP BY i.id"),
    ("s", f"SELECT id, CAST(b AS INTEGER) AS slot, list_reduce(list_slice(raw, b * 2 + 1, b * 2 + 2), lambda s, f: {_STEP}) AS val FROM rz, range({WTA_SLOTS}) AS n(b)"),
    *sql.index(CAP), *sql.collisions(), *sql.top(K),
]


@query(sql.with_(*_TO_WTA, final=f"SELECT id, rank, neighbor_id, 1 - cnt / {float(WTA_SLOTS)}::DOUBLE AS distance FROM t"))
def wta_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wta().fit(datasets.embeddings(spark, sf_dir)).kneighbors(fast=True)


# exact measures


@query(sql.with_(sql.data("baskets"), final="SELECT id, sum(v * v) AS norm FROM x GROUP BY id"))
def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.baskets(spark, sf_dir).select("id", exact.squared_norm(F.col("values")).alias("norm"))


_TO_C = [sql.data("baskets"), *sql.minhash(H), *sql.index(CAP), *sql.collisions()]
_TO_C_TOKENS = [sql.data("tokens"), *sql.minhash(H), *sql.index(CAP), *sql.collisions()]


@query(sql.with_(*_TO_C, *sql.top(K), *sql.measured("t", "e", False), final="SELECT id, neighbor_id, xx, yy, xy FROM e"))
def dot_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datasets.baskets(spark, sf_dir)
    model = _minhash().fit(rows)
    return exact.dot_products(model.kneighbors(fast=True), rows, rows)


def _round_one(name: str, similarity: bool) -> str:
    start = _TO_C if name == "baskets" else _TO_C_TOKENS
    return sql.with_(*start, *sql.top(K * EXCESS), *sql.measured("t", "e", similarity), *sql.ranked("e", "k", K, similarity), final="SELECT id, neighbor_id, distance, rank FROM k")


def _knn(spark, sf_dir, build, similarity) -> DataFrame:
    rows = build(spark, sf_dir)
    model = _minhash().fit(rows)
    top = cand.ranked(model.index, K * EXCESS).select("id", "neighbor_id")
    return exact.refined(top, K, EXCESS, rows, rows, similarity, expand=False, precision=6)


@query(_round_one("baskets", False))
def knn_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, datasets.baskets, False)


@query(_round_one("tokens", True))
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, datasets.tokens, True)


_EXPANDED = "SELECT id, rank, neighbor_id, distance FROM k"


@query(sql.with_(*_TO_C, *sql.expanded(K, EXCESS, False), final=_EXPANDED))
def knn_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash().fit(datasets.baskets(spark, sf_dir)).kneighbors()


@query(sql.with_(*_TO_C_TOKENS, *sql.expanded(K, EXCESS, True), final=_EXPANDED))
def knn_expanded_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash().fit(datasets.tokens(spark, sf_dir)).kneighbors(similarity=True)


@query(sql.with_(
    ("xa", sql.DATA["baskets"]), *_HALVES, *sql.minhash(H), *sql.index(CAP), *sql.minhash(H, "xo", "q"),
    ("c", "SELECT a.id, b.id AS neighbor_id, count(*) AS cnt FROM i a JOIN i b USING (slot, val) WHERE a.id <> b.id GROUP BY ALL"),
    ("cq", "SELECT q.id, i.id AS neighbor_id, count(*) AS cnt FROM q JOIN i USING (slot, val) GROUP BY ALL"),
    *sql.top(K * EXCESS, "t", "c"), *sql.top(K * EXCESS, "tq", "cq"), ("xall", "SELECT * FROM xa"),
    *[(n, t.replace("FROM x GROUP", "FROM xa GROUP")) for n, t in sql.measured("t", "e", False)], *sql.ranked("e", "r2", min(100, K + EXCESS), False),
    *[(n, t.replace("FROM x GROUP", "FROM xa GROUP")) for n, t in sql.measured("tq", "eq", False, "xo")], *sql.ranked("eq", "r1", min(100, K + EXCESS), False),
    ("a", f"SELECT id, neighbor_id FROM r1 UNION SELECT r.id, f.neighbor_id FROM r1 r JOIN r2 f ON f.id = r.neighbor_id WHERE r.rank <= {K}"),
    *[(n, t.replace("FROM x GROUP", "FROM xa GROUP")) for n, t in sql.measured("a", "e2", False, "xo")], *sql.ranked("e2", "k", K, False),
    final=_EXPANDED,
))
def query_set_knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datasets.baskets(spark, sf_dir)
    return _minhash().fit(rows.where("id % 2 = 0")).kneighbors(rows.where("id % 2 = 1"))


RADIUS = 300.0


@query(sql.with_(*_TO_C, *sql.measured("c", "e", False), *[(n, t.replace("FROM e", f"FROM (SELECT * FROM e WHERE distance <= {RADIUS})")) for n, t in sql.ranked("e", "k", 2**31 - 1, False)], final=_EXPANDED))
def radius_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash().fit(datasets.baskets(spark, sf_dir)).radius_neighbors(radius=RADIUS)


@query(sql.with_(*_TO_C_TOKENS, *sql.measured("c", "e", True), *[(n, t.replace("FROM e", "FROM (SELECT * FROM e WHERE 1 - distance <= 0.3)")) for n, t in sql.ranked("e", "k", 2**31 - 1, True)], final=_EXPANDED))
def radius_neighbors_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash().fit(datasets.tokens(spark, sf_dir)).radius_neighbors(radius=0.3, similarity=True)


@query(sql.with_(*_TO_C_TOKENS, ("e", f"SELECT id, neighbor_id, 1 - cnt / {float(H)}::DOUBLE AS distance FROM c"), *[(n, t.replace("FROM e", "FROM (SELECT * FROM e WHERE distance <= 0.5)")) for n, t in sql.ranked("e", "k", 2**31 - 1, False)], final=_EXPANDED))
def radius_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash().fit(datasets.tokens(spark, sf_dir)).radius_neighbors(radius=0.5, fast=True)


# graphs and array forms


@query(sql.with_(*_TO_C, *sql.top(K), final="SELECT id AS src, neighbor_id AS dst, 1.0::DOUBLE AS weight FROM t"))
def knn_graph_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash().fit(datasets.baskets(spark, sf_dir)).kneighbors_graph(fast=True, symmetric=False)


@query(sql.with_(*_TO_C, *sql.top(K), final=sql.symmetric("t", f"1 - cnt / {float(H)}::DOUBLE")))
def knn_graph_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash().fit(datasets.baskets(spark, sf_dir)).kneighbors_graph(fast=True, mode="distance")


@query(sql.with_(*_TO_C_TOKENS, ("e", f"SELECT id, neighbor_id, 1 - cnt / {float(H)}::DOUBLE AS distance FROM c WHERE 1 - cnt / {float(H)}::DOUBLE <= 0.5"), final=sql.symmetric("e", "1.0::DOUBLE")))
def radius_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash().fit(datasets.tokens(spark, sf_dir)).radius_neighbors_graph(radius=0.5, fast=True)


_ARRAY = f"""SELECT x.id, array_to_string(list_resize(coalesce(list(neighbor_id ORDER BY rank) FILTER (rank IS NOT NULL), []), {K}, -1), ',') AS neighbors
FROM (SELECT DISTINCT id FROM x) x LEFT JOIN t USING (id) GROUP BY x.id"""


@query(sql.with_(*_TO_C, *sql.top(K), final=_ARRAY))
def knn_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datasets.baskets(spark, sf_dir)
    arrays = graph.as_arrays(_minhash().fit(rows).kneighbors(fast=True), rows, K)
    return arrays.select("id", F.concat_ws(",", F.col("neighbors").cast("array<string>")).alias("neighbors"))


# labels

_VOTES = ("v", "SELECT t.id, label, count(*) AS n FROM t JOIN embeddings ON vec_id = neighbor_id WHERE label IS NOT NULL GROUP BY ALL")
_BEST = ("p", "SELECT id, label FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1")
_PREDICTED = ("o", "SELECT vec_id AS id, coalesce(p.label, -1) AS label FROM embeddings LEFT JOIN p ON p.id = vec_id")


def _labelled(spark, sf_dir):
    labels = datasets.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    options = _wta().params
    model = classify.WtaHashClassifier(fast=True, **{k: v for k, v in options.items() if k != "fast"}).fit(datasets.embeddings(spark, sf_dir), labels)
    _kept(model.model)
    return model, labels


@query(sql.with_(*_TO_WTA, _VOTES, _BEST, _PREDICTED, final="SELECT * FROM o"))
def knn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir)[0].predict()


_PROBA = ", ".join(f"coalesce(sum(n) FILTER (label = {c}) / sum(n), 0) AS p_{c}" for c in range(10))


@query(sql.with_(*_TO_WTA, _VOTES, final=f"SELECT vec_id AS id, {_PROBA.replace('label', 'v.label')} FROM embeddings LEFT JOIN v ON v.id = vec_id GROUP BY vec_id"))
def predict_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir)[0].predict_proba(classes=list(range(10)))


@query(sql.with_(*_TO_WTA, _VOTES, _BEST, _PREDICTED, final="SELECT avg(CAST(o.label = e.label AS INTEGER)) AS accuracy FROM o JOIN embeddings e ON vec_id = id"))
def knn_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, labels = _labelled(spark, sf_dir)
    return classify.accuracy(model.predict(), labels)


_THIRDS = ("v", "SELECT t.id, neighbor_id % 3 AS label, count(*) AS n FROM t GROUP BY ALL")
_OF_THIRDS = [*_TO_C, *sql.top(K), _THIRDS, _BEST]


def _thirds(spark, sf_dir):
    rows = datasets.baskets(spark, sf_dir)
    labels = rows.select("id", (F.col("id") % 3).alias("label"), (F.col("id") % 5 + 1).cast("double").alias("weight"))
    options = {k: v for k, v in _minhash().params.items() if k != "fast"}
    model = classify.MinHashClassifier(fast=True, **options).fit(rows, labels.select("id", "label"))
    _kept(model.model)
    return model, rows, labels


@query(sql.with_(*_OF_THIRDS, final="SELECT x.id, coalesce(p.label, -1) AS label FROM (SELECT DISTINCT id FROM x) x LEFT JOIN p USING (id)"))
def minhash_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thirds(spark, sf_dir)[0].predict()


@query(sql.with_(*_OF_THIRDS, final="SELECT round(sum((id % 5 + 1) * CAST(coalesce(p.label, -1) = id % 3 AS INTEGER)) / sum(id % 5 + 1), 9) AS accuracy FROM (SELECT DISTINCT id FROM x) x LEFT JOIN p USING (id)"))
def minhash_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _, labels = _thirds(spark, sf_dir)
    return classify.accuracy(model.predict(), labels, "weight").select(F.round("accuracy", 9).alias("accuracy"))


@query(sql.with_(
    *_TO_C_TOKENS, *sql.expanded(10, EXCESS, True),
    ("xq", "SELECT * FROM x WHERE id % 20 = 0"),
    ("w", "SELECT a.id, b.id AS neighbor_id FROM xq a JOIN x b USING (f) WHERE a.id <> b.id GROUP BY ALL"),
    *sql.measured("w", "y", True), *sql.ranked("y", "z", 10, True),
    final="SELECT round(count(k.id) / count(*), 6) AS recall FROM z LEFT JOIN k USING (id, neighbor_id)",
))
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the truth for the query rows, those with an id divisible by 20."""
    rows = materialize(datasets.tokens(spark, sf_dir))  # read again and again
    found = _minhash(n_neighbors=10).fit(rows).kneighbors(similarity=True)
    truth = exact.exact_neighbors(rows, 10, rows.where("id % 20 = 0"), precision=6)
    return exact.recall(found, truth).select(F.round("recall", 6).alias("recall"))


# the forms of fitting and querying at once


@query(_fast("baskets"))
def fit_kneighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash().fit_kneighbors(datasets.baskets(spark, sf_dir), fast=True)


@query(sql.with_(*_TO_C, *sql.top(K), final=sql.symmetric("t", "1.0::DOUBLE")))
def fit_kneighbors_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash().fit_kneighbors_graph(datasets.baskets(spark, sf_dir), fast=True)


_NEAR_TOKENS = ("e", f"SELECT id, neighbor_id, 1 - cnt / {float(H)}::DOUBLE AS distance FROM c WHERE 1 - cnt / {float(H)}::DOUBLE <= 0.7")


@query(sql.with_(*_TO_C_TOKENS, _NEAR_TOKENS, *sql.ranked("e", "k", 2**31 - 1, False), final=_EXPANDED))
def fit_radius_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash().fit_radius_neighbors(datasets.tokens(spark, sf_dir), radius=0.7, fast=True)


@query(sql.with_(*_TO_C_TOKENS, _NEAR_TOKENS, final=sql.symmetric("e", "distance")))
def fit_radius_neighbors_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash().fit_radius_neighbors_graph(datasets.tokens(spark, sf_dir), radius=0.7, fast=True, mode="distance")


@query(sql.with_(*_TO_C_TOKENS, _NEAR_TOKENS, *sql.ranked("e", "k", 2**31 - 1, False), final="""
    SELECT x.id, coalesce(string_agg(CAST(neighbor_id AS VARCHAR), ',' ORDER BY rank), '') AS neighbors, coalesce(string_agg(CAST(CAST(distance * 32 AS INTEGER) AS VARCHAR), ',' ORDER BY rank), '') AS distances
    FROM (SELECT DISTINCT id FROM x) x LEFT JOIN k USING (id) GROUP BY x.id"""))  # fmt: skip
def radius_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists as long as they are; distances in 32nds."""
    rows = datasets.tokens(spark, sf_dir)
    arrays = graph.as_arrays(_minhash().fit(rows).radius_neighbors(radius=0.7, fast=True), rows)
    parts = F.transform("distances", lambda d: (d * 32).cast("int").cast("string"))
    return arrays.select("id", F.concat_ws(",", F.col("neighbors").cast("array<string>")).alias("neighbors"), F.concat_ws(",", parts).alias("distances"))


# tuned sets of parameters


def _tuned(algorithm: str, goal: str) -> str:
    p = PRESETS[algorithm, goal]
    h, prune, lsb, less = p["number_of_hash_functions"], p["prune_inverse_index"], p["store_value_with_least_sigificant_bit"], p["remove_hash_function_with_less_entries_as"]
    data = sql.data("baskets" if algorithm == "minhash" else "embeddings")
    if p["shingle"]:
        size = p["shingle_size"]
        signed = [*sql.minhash(h * p["block_size"], "x", "r"), ("l", "SELECT id, list(val ORDER BY slot) AS raw FROM r GROUP BY id")]
        signed.append(("s", f"SELECT id, CAST(b AS INTEGER) AS slot, list_reduce(list_slice(raw, b * {size} + 1, b * {size} + {size}), lambda s, f: {_STEP}) AS val FROM l, range({-(-h * p['block_size'] // size)}) AS n(b)"))
        h = -(-h * p["block_size"] // size)
    else:
        signed = sql.minhash(h) if algorithm == "minhash" else sql.wta(h, p["rangeK_wta"])
    return sql.with_(data, *signed, *sql.index(p["max_bin_size"], prune, lsb, less), *sql.collisions(), *sql.top(K), final=f"SELECT id, rank, neighbor_id, 1 - cnt / {float(h)}::DOUBLE AS distance FROM t")


@query(_tuned("minhash", "speed"))
def preset_minhash_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(MinHash(speed_optimized=True, n_neighbors=K)).fit(datasets.baskets(spark, sf_dir)).kneighbors(fast=True)


@query(_tuned("minhash", "accuracy"))
def preset_minhash_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(MinHash(accuracy_optimized=True, n_neighbors=K)).fit(datasets.baskets(spark, sf_dir)).kneighbors(fast=True)


@query(_tuned("wta", "speed"))
def preset_wta_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(WtaHash(speed_optimized=True, n_neighbors=K)).fit(datasets.embeddings(spark, sf_dir)).kneighbors(fast=True)


@query(_tuned("wta", "accuracy"))
def preset_wta_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(WtaHash(accuracy_optimized=True, n_neighbors=K)).fit(datasets.embeddings(spark, sf_dir)).kneighbors(fast=True)


# sources


@query("SELECT n_regionkey AS id, n_nationkey::BIGINT AS f, CAST(n_nationkey + 1 AS DOUBLE) AS v FROM nation")
def csr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of regions and nations, small as what a driver holds should be."""
    cells = sorted((r["n_regionkey"], r["n_nationkey"]) for r in datasets.table(spark, sf_dir, "nation").collect())
    starts = [sum(region < i for region, _ in cells) for i in range(max(region for region, _ in cells) + 2)]
    long = to_long(from_csr(spark, starts, [n for _, n in cells], [n + 1.0 for _, n in cells]))
    return long.select(F.col("id").cast("int").alias("id"), "f", "v")


@query(sql.with_(sql.data("baskets"), final="SELECT id, f, v FROM x WHERE id % 10 = 0"))
def matrix_market_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baskets of every tenth customer, written as a coordinate file and read."""
    cells = to_long(datasets.baskets(spark, sf_dir)).where("id % 10 = 0").select(F.concat_ws(" ", F.col("id") + 1, F.col("f") + 1, "v").alias("value"))
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate real general"), (1, "% sizes"), (2, "0 0 0")], "n int, value string")
    lines = head.unionByName(cells.select(F.lit(3).alias("n"), "value")).coalesce(1).sortWithinPartitions("n").select("value")
    path = f"{shared_dir(spark)}/nearfield-mtx-{uuid.uuid4().hex}"
    lines.write.text(path)
    return to_long(read_matrix_market(spark, path))


# clusters

EPS, MIN_SAMPLES = 20.0, 3


@query(sql.with_(
    *_TO_C_TOKENS, *sql.expanded(K, EXCESS, False), ("e3", sql.symmetric("k", "distance")),
    ("n", f"SELECT src, dst FROM e3 WHERE weight <= {EPS}"),
    ("co", f"SELECT src AS id FROM n GROUP BY src HAVING count(*) + 1 >= {MIN_SAMPLES}"),
    ("re", "SELECT id, id AS to_ FROM co UNION SELECT re.id, n.dst FROM re JOIN n ON n.src = re.to_ JOIN co ON co.id = n.dst"),
    ("la", "SELECT id, min(to_) AS label FROM re GROUP BY id"),
    ("bo", "SELECT n.src AS id, min(label) AS label FROM n JOIN la ON la.id = n.dst GROUP BY n.src"),
    final="SELECT DISTINCT x.id, coalesce(la.label, bo.label, -1) AS label FROM x LEFT JOIN la USING (id) LEFT JOIN bo ON bo.id = x.id",
    recursive=True,
))
def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = {k: v for k, v in _minhash().params.items() if k != "n_neighbors"}
    dbscan = cluster.MinHashDBSCAN(EPS, MIN_SAMPLES, K, precision=6, **p)
    _kept(dbscan.model)
    return dbscan.fit_predict(datasets.tokens(spark, sf_dir))


@query()
def pic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = {k: v for k, v in _minhash().params.items() if k != "n_neighbors"}
    spectral = cluster.MinHashSpectralClustering(4, K, 10, precision=6, **p)
    _kept(spectral.model)
    return spectral.fit_predict(datasets.tokens(spark, sf_dir))


@query()
def pca_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the first components of the distance graph of the vectors."""
    from pyspark.ml.clustering import KMeans

    model = cluster.MinHashClustering(_wta(fast=True), KMeans(k=4, seed=1, maxIter=5))
    return model.fit_predict(datasets.embeddings(spark, sf_dir), pPca=True, pPcaDimensions=3)
