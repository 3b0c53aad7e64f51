"""Steps whose rows must not grow with the square of a group, told by the rows that the nodes of the executed plan made, and steps that must not deal rows by a key that most of them have."""

import json

from pyspark.sql import functions as F

from tessera.functions import units
from tessera.operators import definitions as df
from tessera.operators import maps
from tessera.sources import resources


def made(frame):
    """The result's rows in order, and the most rows that one node of the plan made."""
    got, most, left = sorted(map(tuple, frame.collect()), key=repr), 0, [frame._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            node = node.executedPlan()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        metrics = node.metrics()
        most = max(most, metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0)
        left += [node.children().apply(k) for k in range(node.children().size())]
    return got, most


def test_narrowest_wide_target(spark):
    """A target with many codes below it, which many concepts have."""
    pairs = spark.range(300).selectExpr("'wide' AS ancestor", "concat('n', id) AS descendant")
    rels = spark.range(300).selectExpr("concat('s', id) AS source", "1 AS grp", "'r' AS rel", "explode(array('wide', if(id < 3, concat('n', id), 'other'))) AS target")
    got, most = made(df.narrowest(rels, pairs))
    assert len(got) == 597 and ("s3", 1, "r", "wide") in got and ("s2", 1, "r", "wide") not in got and ("s2", 1, "r", "n2") in got
    assert most <= 1000


def test_translated_copies(spark):
    """Requests that ask the same, and mappings that answer the same; the first mapping of all stays, also for an id that asks two things."""
    to = [{"code": "x", "relationship": "equivalent", "comment": str(k)} for k in range(300)]
    text = json.dumps({"resourceType": "ConceptMap", "url": "m", "group": [{"source": "s", "target": "t", "element": [{"code": "b", "target": [{"code": "x", "relationship": "equivalent", "comment": "b"}]}, {"code": "a", "target": to}]}]})
    found = resources.mappings(spark.createDataFrame([(text,)], "json string"))
    req = spark.range(300).selectExpr("id AS req_id", "'s' AS system", "string(NULL) AS version", "explode(if(id = 7, array('a', 'b'), array('a'))) AS code", "string(NULL) AS scope", "string(NULL) AS to_system")
    got, most = made(maps.translated(req, found).select("req_id", "system", "code", "comment"))
    assert got == sorted(((k, "t", "x", "b" if k == 7 else "0") for k in range(300)), key=repr)
    assert most <= 1000


def test_translated_copies_reverse(spark):
    """Many sources of one target, and requests that ask the same; a request gets each source once."""
    element = [{"code": f"a{k % 5}", "target": [{"code": "x", "relationship": "equivalent", "comment": str(k)}]} for k in range(300)]
    found = resources.mappings(spark.createDataFrame([(json.dumps({"resourceType": "ConceptMap", "url": "m", "group": [{"source": "s", "target": "t", "element": element}]}),)], "json string"))
    req = spark.range(300).selectExpr("id AS req_id", "'t' AS system", "string(NULL) AS version", "'x' AS code", "string(NULL) AS scope", "string(NULL) AS to_system")
    got, most = made(maps.translated(req, found, reverse=True).select("req_id", "system", "code", "comment"))
    assert got == sorted(((k, "s", f"a{n}", str(n)) for k in range(300) for n in range(5)), key=repr)
    assert most <= 2000


def test_translated_rows_in_several_tasks(spark):
    """A small table of requests that ask the same gives very many rows: no one task makes them all."""
    element = [{"code": f"a{k}", "target": [{"code": "x", "relationship": "equivalent"}]} for k in range(400)]
    found = resources.mappings(spark.createDataFrame([(json.dumps({"resourceType": "ConceptMap", "url": "m", "group": [{"source": "s", "target": "t", "element": element}]}),)], "json string"))
    req = spark.range(4000).selectExpr("id AS req_id", "'t' AS system", "string(NULL) AS version", "'x' AS code", "string(NULL) AS scope", "string(NULL) AS to_system")
    out = maps.translated(req, found, reverse=True).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum(F.xxhash64("req_id", "code").cast("decimal(38)")).alias("h")).collect()
    want = spark.range(4000).withColumnRenamed("id", "req_id").join(spark.range(400).selectExpr("concat('a', id) AS code")).agg(F.sum(F.xxhash64("req_id", "code").cast("decimal(38)"))).first()[0]
    assert sum(r["n"] for r in out) == 1_600_000 and sum(r["h"] for r in out) == want
    assert max(r["n"] for r in out) <= 1_200_000


def test_units_stay_where_rows_are(spark):
    r = spark.createDataFrame([(1, "mg/dL"), (2, "kg"), (3, None), (4, "wrong"), (5, "kg/m3"), (6, "")], "id long, unit string")
    out = units.measures_same(r, "g/L")
    assert made(out)[0] == [(1,), (5,)] and units.measures_same(r, "wrong").collect() == []
    pairs = r.selectExpr("id", "2.0D AS value", "unit AS source", "'g/L' AS target")
    turned = units.converted(pairs)
    assert [(x[0], x[4]) for x in made(turned)[0]] == [(1, 0.02), (2, None), (3, None), (4, None), (5, 2.0), (6, None)]
    assert not any("Exchange" in f._jdf.queryExecution().executedPlan().toString() for f in (out, turned))


def test_subsumed_large_definitions(spark):
    """Two concepts with many pairs of one type."""
    pairs = spark.range(300).selectExpr("concat('w', id) AS ancestor", "concat('n', id) AS descendant")
    rels = spark.range(300).selectExpr("inline(array(struct('a' AS source, 1 AS grp, 'r' AS rel, concat('w', id) AS target), struct('b' AS source, 2 AS grp, 'r' AS rel, concat('n', id) AS target)))")
    got, most = made(df.subsumed(spark.createDataFrame([("a", "b"), ("b", "a")], "code_a string, code_b string"), rels, pairs))
    assert got == [("a", "b", True), ("b", "a", False)]
    assert most <= 5000
