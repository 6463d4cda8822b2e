from tidewater.operators.orders import ranges


def test_edges_are_found_once(spark):
    """Approximate quantiles differ from run to run; both uses of the edges in one plan must see the same."""
    edges = ranges(spark.range(10_000).withColumnRenamed("id", "x"), "x", 64)
    assert "percentile" not in edges._jdf.queryExecution().optimizedPlan().toString()
    first = edges.first()
    assert len(first._e) == 63 and len(first._c) == 7 and edges.first() == first
    assert ranges(spark.range(0).withColumnRenamed("id", "x"), "x", 64).count() == 1
