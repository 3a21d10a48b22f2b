"""The nearest nodes come back without a broadcast: what was saved is larger in memory than its file tells."""

from wegloom.operators import network


def test_no_broadcast(spark):
    points = spark.range(50).selectExpr("id point_id", "id * 10.0D px", "0.0D py")
    nodes = spark.range(30).selectExpr("id node", "id * 17.0D x", "1.0D y")
    d = network.nearest_nodes(points, nodes, 100.0)
    assert "BroadcastHashJoin" not in d._jdf.queryExecution().toString()
    assert {r["point_id"]: r["road_node"] for r in d.collect()} == {i: min(range(30), key=lambda n: ((n * 17 - i * 10) ** 2, n)) for i in range(50)}
