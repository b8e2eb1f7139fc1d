"""Components of a graph."""

from harrow.operators import graph


def test_no_label_passes_through_the_driver(spark, monkeypatch):
    plans, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda rows, name: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or real(rows, name))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (103, 102)], "a long, b long")
    found = {r.node: r.component for r in graph.components(edges).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 102: 102, 103: 102}
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
