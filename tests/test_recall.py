"""Recall of the registered inverted-file query against exact search."""

import pytest

import __spark_entry__ as entry
from postlens.operators import ivf


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_ivf_query_finds_the_neighbours(spark, size):
    found, truth = (entry.QUERIES[name](spark, f"/root/testdata/{size}") for name in ("ivf_search", "knn_search"))
    recall = ivf.recall_of(found, truth, "query_id", "vec_id").first()["recall"]
    print("recall", size, recall)
    assert recall >= 0.9
