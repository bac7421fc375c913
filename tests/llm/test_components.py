from pairloom.llm import components


def test_rounds_broadcast_nothing(spark):
    # what is broadcast passes the driver, round after round
    edges = spark.createDataFrame([(2, 1), (3, 2), (7, 5), (7, 6)], "u long, v long")
    step = components._small_star(components._large_star(edges))
    step.collect()  # a join is changed to a broadcast as it runs
    plan = step._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5}
