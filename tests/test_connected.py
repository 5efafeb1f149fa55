"""Connected components."""

from attestry.operators import connected


def test_a_path_and_a_pair(spark):
    pair = spark.range(900, 901).selectExpr("id as a", "id + 7 as b")
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").union(pair)
    roots = {r.node: r.root for r in connected.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(1, 201)}, 907: 900}


def test_names_loops_and_repeats(spark):
    edges = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "c"), ("c", "b"), ("x", "y")], "a string, b string")
    roots = {r.node: r.root for r in connected.components(edges).collect()}
    assert roots == {"b": "a", "c": "a", "y": "x"}
    assert connected.components(edges.limit(0)).count() == 0
