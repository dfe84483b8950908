"""Components that are cut short are an error, not a result."""

import pytest

from specgraph.operators import analytics


def test_components_converge_or_fail(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src_id long, dst_id long")
    nodes = spark.createDataFrame([(i,) for i in range(41)], "node_id long")
    with pytest.raises(RuntimeError):
        analytics.components(nodes, chain, rounds=1)
    assert {r.component for r in analytics.components(nodes, chain).collect()} == {0}
    assert {r.component for r in analytics.components(nodes, chain.limit(0)).collect()} == set(range(41))
