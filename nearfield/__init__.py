"""Approximate nearest neighbours of sparse rows on Spark.

    from nearfield import MinHash
    model = MinHash(n_neighbors=5).fit(rows)      # rows: id, features, values
    model.kneighbors()                            # id, rank, neighbor_id, distance
"""

import sys

from pyspark import cloudpickle

# functions of this package travel with their tasks, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from nearfield.operators.cluster import MinHashClustering, MinHashDBSCAN, MinHashSpectralClustering  # noqa: E402
from nearfield.operators.classify import MinHashClassifier, WtaHashClassifier  # noqa: E402
from nearfield.plans.model import MinHash, WtaHash  # noqa: E402

__all__ = ["MinHash", "MinHashClassifier", "MinHashClustering", "MinHashDBSCAN", "MinHashSpectralClustering", "WtaHash", "WtaHashClassifier"]
