"""Operators whose work once grew with a square: places of many matches, pairs in large groups."""

import itertools
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.functions import extract
from dossier.operators import graph

RNG = np.random.default_rng(4)


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 1000])
def test_sums_before(spark, n):
    numbers = [int(x) for x in RNG.integers(0, 50, n)]
    got = spark.createDataFrame([(numbers,)], "a array<int>").select(extract.sums_before(F.col("a")).alias("s")).first().s
    assert got == [sum(numbers[:i]) for i in range(n)]


def test_hits(spark):
    texts = ["", "ab", "é1", "12é345", *("".join(RNG.choice(list("aé1 "), 700)) for _ in range(3))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", extract.hits(F.col("t"), r"(?U)\d+").alias("h")).collect()
    for r in got:
        assert [(x.literal, x.start, x.end) for x in r.h or []] == [(m[0], m.start(), m.end()) for m in re.finditer(r"\d+", r.t)]


def test_very_many_hits(spark):
    """From 1,000 to 30,000 citations a page the time may grow forty-fold, not nine-hundred-fold."""

    def took(n):
        page = spark.createDataFrame([(1, 1, "x HC 123.456 y " * n)], "documento_id bigint, pagina int, texto string")
        began = time.time()
        assert page.select(F.size(extract.hits(F.col("texto"), extract.CITED)).alias("n")).first().n == n
        return time.time() - began

    took(10)
    assert took(30_000) < 40 * max(took(1_000), 0.3)


@pytest.mark.parametrize("tile", [1, 3, 1000])
def test_pairs_within(spark, tile):
    groups = {1: range(40), 2: [5], 3: [1, 2], None: [7, 8]}
    rows = [(g, f"n{i}") for g, own in groups.items() for i in own]
    got = graph.pairs_within(spark.createDataFrame(rows, "g int, name string"), "g", "name", tile).collect()
    want = [(g, *sorted(p)) for g, own in groups.items() if g for p in itertools.combinations([f"n{i}" for i in own], 2)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_a_large_group_is_spread(spark):
    """No key of a group of 20,000 members holds more than two tiles."""
    members = spark.range(20_000).selectExpr("1 AS g", "concat('n', id) AS name")
    k = -(-20_000 // graph.TILE)
    dealt = members.withColumn("t", F.pmod(F.xxhash64("name"), F.lit(k)))
    assert dealt.groupBy("t").count().agg(F.max("count")).first()[0] < 2 * graph.TILE
    assert graph.pairs_within(members, "g", "name").count() == 20_000 * 19_999 // 2
