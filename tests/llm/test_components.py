"""Components of graphs whose ids run in any order."""

import numpy as np

from foliospark.llm import common


def test_components_of_long_chains_in_random_order(spark):
    """Two chains of random ids, one with a star at its end; a self-loop, a repeated edge and nulls."""
    ids = [int(i) for i in np.random.default_rng(7).permutation(6000)]
    one, two, star = ids[:3000], ids[3000:5000], ids[5000:5900]
    edges = [*zip(one, one[1:]), *zip(two, two[1:]), *((two[-1], i) for i in star), (ids[5999], ids[5999]), (one[1], one[0]), (one[0], None), (None, None)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: min(one) for i in one} | {i: min(two + star) for i in two + star} | {ids[5999]: ids[5999]}
    assert got == want


def test_components_of_no_edges(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
