"""Neighbours among many ties and far from the centre, where every leaf is looked at."""

import numpy as np
import pytest

from dossier.llm import neighbours

RNG = np.random.default_rng(21)


@pytest.mark.parametrize("x", [RNG.choice([-1.0, 1.0], (500, 16)), 1e6 + 1e-4 * RNG.normal(size=(500, 16))], ids=["ties", "off centre"])
def test_leaves_are_ranked_exactly(spark, x):
    ids = RNG.permutation(500)
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<double>")
    got = neighbours.nearest(table, table.where("vec_id % 50 = 0"), leaf=1000, trees=1, leaves=1).toPandas()
    assert got["query_id"].nunique() == 10
    for q, own in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        own = own.sort_values("rank")
        assert own["vec_id"].tolist() == ids[best].tolist() and own["score"].tolist() == d[best].tolist()
