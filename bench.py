"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints a line
of JSON: seconds for each, their sum, rows a second of the signatures, and recall."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
MEMORY = os.environ.get("BENCH_MEMORY", "12g")


def timed(df) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - began, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", MEMORY).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).config("spark.executorEnv.PYTHONPATH", str(ROOT)).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from nearfield import MinHash
    from nearfield.operators.signature import minhash_sql, signatures
    from nearfield.plans import queries
    from nearfield.sources import datasets

    seconds: dict[str, float] = {}
    rates: dict[str, float] = {}
    rows = datasets.baskets(spark, SF).persist()
    n = rows.count()
    timed(signatures(rows, 4))  # starts the Python workers
    for h in (32, 200, 400):
        seconds[f"signature_{h}"] = timed(signatures(rows, h))
        rates[f"signature_{h}"] = round(n / seconds[f"signature_{h}"])
    seconds["signature_native_32"] = timed(minhash_sql(rows, 32))
    model = MinHash(number_of_hash_functions=32, max_bin_size=50, n_neighbors=10, precision=6).fit(rows)
    seconds["index_build"] = timed(model.index)
    seconds["knn_fast"] = timed(model.kneighbors(fast=True))
    seconds["knn_exact"] = timed(model.kneighbors())
    model.close()
    began = time.time()
    recall = queries.recall_at_k(spark, SF).first()["recall"]
    seconds["recall_at_k"] = round(time.time() - began, 3)
    for name in ("candidates_fast_tokens", "knn_cosine", "knn_graph_symmetric", "knn_predict"):
        seconds[name] = timed(queries.QUERIES[name](spark, SF))
    found = None
    try:
        from nearfield.llm.queries import QUERIES as found
    except ModuleNotFoundError as e:
        if e.name not in ("nearfield.llm", "nearfield.llm.queries"):
            raise
    for name, query in (found or {}).items():
        began = time.time()
        query(spark, SF).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "sum of seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF, "cpus": int(CPUS), "memory": MEMORY, "spark": spark.version, "rows": n, "rows_per_second": rates, "recall_at_10": recall}))


if __name__ == "__main__":
    main()
