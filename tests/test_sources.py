import datetime
import gzip
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import hierarchy as h
from tessera.operators import valuesets as vs
from tessera.sources import releases as rel
from tessera.sources import resources as res
from tessera.streaming import sync

SYSTEM = {
    "resourceType": "CodeSystem", "url": "http://x/cs", "version": "1",
    "concept": [
        {"code": "a", "display": "A", "property": [{"code": "size", "valueInteger": 3}], "designation": [{"language": "de", "value": "Ah"}],
         "concept": [{"code": "b", "concept": [{"code": "c", "display": "C"}]}, {"code": "d", "property": [{"code": "parent", "valueCode": "e"}]}]},
        {"code": "e", "property": [{"code": "notSelectable", "valueBoolean": True}]},
    ],
}


def frame(spark, *resources):
    return spark.createDataFrame([(res.as_json(r),) for r in resources] + [("not json",)], "json string")


def test_nested_concepts(spark):
    rows = res.concepts(frame(spark, SYSTEM))
    got = sorted((r["code"], r["parent_code"], r["depth"]) for r in rows.collect())
    assert got == [("a", None, 0), ("b", "a", 1), ("c", "b", 2), ("d", "a", 1), ("e", None, 0)]
    assert sorted((r["parent"], r["child"]) for r in res.concept_edges(rows).collect()) == [("a", "b"), ("a", "d"), ("b", "c"), ("e", "d")]
    assert sorted((r["code"], r["prop"], r["value"]) for r in res.concept_properties(rows).collect()) == [("a", "size", "3"), ("d", "parent", "e"), ("e", "notSelectable", "true")]
    assert [(r["lang"], r["value"]) for r in res.concept_designations(rows).collect()] == [("de", "Ah")]


def test_value_sets_and_maps(spark):
    vset = {"resourceType": "ValueSet", "url": "u", "compose": {"include": [{"system": "s", "concept": [{"code": "1"}]}, {"valueSet": ["v"]}], "exclude": [{"system": "s", "filter": [{"property": "p", "op": "is-a", "value": "x"}]}]}}
    got = sorted((r["kind"], r["clause_ord"], r["system"], r["imports"]) for r in res.value_set_clauses(frame(spark, vset, SYSTEM)).collect())
    assert got == [("exclude", 0, "s", None), ("include", 0, "s", None), ("include", 1, None, ["v"])]
    cmap = {"resourceType": "ConceptMap", "url": "m", "group": [{"source": "s", "target": "t", "element": [{"code": "1", "target": [{"code": "x", "equivalence": "wider"}, {"code": "y", "relationship": "related-to"}]}]}]}
    assert sorted((r["target_code"], r["relationship"]) for r in res.map_rows(frame(spark, cmap)).collect()) == [("x", "source-is-broader-than-target"), ("y", "related-to")]


def test_package_and_folder(spark, tmp_path):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name, text in (("package/a.json", res.as_json(SYSTEM)), ("package/readme.md", "x"), ("other/b.json", "{}")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    (tmp_path / "p.tgz").write_bytes(gzip.compress(raw.getvalue()))
    rows = res.packages(spark, str(tmp_path / "p.tgz")).collect()
    assert [r["name"] for r in rows] == ["package/a.json"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f/one.json").write_text(res.as_json(SYSTEM))
    assert res.concepts(res.folder(spark, str(tmp_path / "f"))).count() == 5


def test_release_files(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    r = rel.rf2_relationships(rel.tsv(spark, put("r.txt", "id\tactive\tmoduleId\tsourceId\tdestinationId\trelationshipGroup\ttypeId\tcharacteristicTypeId\n1\t1\tm\t10\t20\t0\t116680003\t900000000000011006\n2\t0\tm\t10\t30\t0\t116680003\t900000000000011006\n")))
    assert [tuple(x) for x in rel.rf2_edges(r).collect()] == [("20", "10")]
    m = rel.rf2_members(rel.tsv(spark, put("m.txt", 'id\teffectiveTime\tactive\tmoduleId\trefsetId\treferencedComponentId\ttargetComponentId\n1\t2\t1\tm\tR\tC\tT "q"\n')), "der2_cRefset_AssociationSnapshot.txt")
    assert [tuple(x) for x in m.collect()] == [("R", "C", ['T "q"'])]
    p = rel.path_closure(rel.csv(spark, put("h.csv", "PATH_TO_ROOT,SEQUENCE,IMMEDIATE_PARENT,CODE,CODE_TEXT\n,1,,A,a\nA,1,A,B,b\nA.B,1,B,C,\"c, \"\"d\"\"\"\n")))
    assert sorted(tuple(x) for x in p.collect()) == [("A", "B", 1), ("A", "C", 2), ("B", "C", 1)]
    x = rel.rrf(spark, put("c.rrf", "C1|2020|2021|1|C2|\n"), ["cui1", "start", "end", "card", "cui2"]).first()
    assert (x["cui1"], x["cui2"]) == ("C1", "C2")
    d = rel.drug_products(rel.tsv(spark, put("p.txt", "PRODUCTID\tPRODUCTNDC\tPROPRIETARYNAME\tNONPROPRIETARYNAME\tSTARTMARKETINGDATE\tENDMARKETINGDATE\tNDC_EXCLUDE_FLAG\n1\t0002-1433\tT\tG\t23880131\t\tN\n2\t0002-1434\tT\tG\t20200131\t\tE\n")), "v1")
    assert sorted((y["code"], y["active"], y["start"]) for y in d.collect()) == [("0002-1433", True, datetime.date(2018, 1, 31)), ("0002-1434", False, datetime.date(2020, 1, 31))]
    k = rel.drug_packages(rel.tsv(spark, put("k.txt", "PRODUCTID\tNDCPACKAGECODE\tPACKAGEDESCRIPTION\n1\t2-143-8\tbox\n9\t1-1-1\tbox\n")), d)
    assert [(y["code"], y["code11"]) for y in k.collect()] == [("2-143-8", "00002014308")]
    names, terms = rel.substances(rel.tsv(spark, put("u.txt", "Name\tTYPE\tUNII\tDisplay Name\nx\tsys\tU1\tX\ny\tcn\tU1\tX\n")))
    assert (names.count(), terms.count()) == (1, 2)


def test_closure_on_cycles_and_diamonds(spark):
    e = lambda rows: spark.createDataFrame(rows, "parent string, child string")
    ring = h.closure(e([("a", "b"), ("b", "c"), ("c", "a")]))
    assert ring.count() == 9 and sorted(r[0] for r in h.has_cycle(ring).collect()) == ["a", "b", "c"]
    d = {(r[0], r[1]): r[2] for r in h.closure(e([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d"), (None, "x")])).collect()}
    assert d[("a", "d")] == 1 and len(d) == 5
    assert h.closure(e([])).count() == 0


def test_too_costly_and_empty_sets(spark):
    rows = spark.range(20).select(F.col("id").cast("string").alias("code"))
    with pytest.raises(vs.TooCostly):
        vs.guarded(rows, 19)
    assert vs.guarded(rows, 20).count() == 20
    assert vs.expand([rows], [rows]).count() == 0
    assert vs.compare(rows.limit(0), rows.limit(0)).first()["outcome"] == "empty"


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    one = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, ver long")
    one.coalesce(1).write.parquet(src)
    run = lambda: sync.sync_stream(spark.readStream.schema(one.schema).parquet(src), str(tmp_path / "state"), str(tmp_path / "ck"), "k", "ver").awaitTermination()
    run()
    spark.createDataFrame([(1, "new", 2), (2, "old", 0), (3, "c", 1)], one.schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "state/v1")).select("k", "v").collect()) == [(1, "new"), (2, "b"), (3, "c")]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    q = sync.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), late="1 hour").writeStream.format("memory").queryName("tumbled").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r[0].replace(tzinfo=None), r[1], r[2]) for r in df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd").cast("date").cast("timestamp_ntz")).collect())
    assert key(spark.table("tumbled")) == key(sync.tumbling(events))
