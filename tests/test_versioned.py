"""Small cases of versioned sets, displays, providers, registries and definitions: nulls, circles, ties, empty tables and errors."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import units, versions
from tessera.operators import definitions as df
from tessera.operators import displays as ds
from tessera.operators import hierarchy as h
from tessera.operators import providers as pv
from tessera.operators import registry as rg
from tessera.operators import versioned as vv
from tessera.sources import resources
from tessera.streaming import sync

CONCEPTS = [("s", "1.0", "a", "A"), ("s", "2.0", "a", "A"), ("s", "2.0", "b", "B"), ("s", "2.0", None, None), ("t", None, "x", "X")]


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def concepts(spark):
    return spark.createDataFrame(CONCEPTS, "system string, version string, code string, display string")


def clauses(spark, *texts):
    return resources.value_set_clauses(spark.createDataFrame([(t,) for t in texts], "json string"))


def expanded(spark, *texts, pairs=()):
    none = spark.createDataFrame([], "system string, prop string, value string, code string")
    walks = spark.createDataFrame(list(pairs), "system string, ancestor string, descendant string")
    return vv.expanded(clauses(spark, *texts), concepts(spark), walks, none)


def value_set(url, include, exclude="[]", version=""):
    return '{"resourceType": "ValueSet", "url": "%s"%s, "compose": {"include": %s, "exclude": %s}}' % (url, version and f', "version": "{version}"', include, exclude)


def test_expanded(spark):
    got = expanded(spark, value_set("u", '[{"system": "s"}, {"system": "s", "version": "1.0"}]', '[{"system": "s", "concept": [{"code": "b"}]}]'))
    assert rows(got.select("vset", "version", "code", "clause_ord")) == [("u", "1.0", "a", 1), ("u", "2.0", "a", 0)]
    # an exclusion of another version only takes that version's codes
    got = expanded(spark, value_set("u", '[{"system": "s", "version": "2.0"}]', '[{"system": "s", "version": "1.0"}]'))
    assert rows(got.select("code")) == [("a",), ("b",)]
    both = value_set("v", '[{"valueSet": ["u"], "system": "s", "version": "2.0", "concept": [{"code": "a"}, {"code": "none"}]}]')
    got = expanded(spark, value_set("u", '[{"system": "s", "version": "2.0"}]'), both)
    assert rows(got.filter("vset = 'v'").select("version", "code", "display")) == [("2.0", "a", "A")]
    is_a = value_set("u", '[{"system": "s", "version": "2.0", "filter": [{"property": "concept", "op": "is-a", "value": "a"}]}]')
    assert rows(expanded(spark, is_a, pairs=[("s", "a", "b")]).select("code")) == [("a",), ("b",)]


def test_expanded_errors(spark):
    with pytest.raises(ValueError, match="circle"):
        expanded(spark, value_set("u", '[{"valueSet": ["v"]}]'), value_set("v", '[{"valueSet": ["u"]}]'))
    with pytest.raises(KeyError):
        expanded(spark, value_set("u", '[{"valueSet": ["nothing"]}]'))
    with pytest.raises(ValueError, match="not supported"):
        expanded(spark, value_set("u", '[{"system": "s", "filter": [{"property": "concept", "op": "odd", "value": "a"}]}]'))
    assert expanded(spark, value_set("u", '[{"system": "unknown"}]')).count() == 0


def test_versions_of_codes(spark):
    req = spark.createDataFrame([(1, "s", "a"), (2, "s", "b"), (3, "s", "z"), (4, "no", "a"), (5, "s", None)], "req_id int, system string, code string")
    assert rows(vv.holding_versions(req, concepts(spark))) == [(1, None), (2, "2.0"), (3, "2.0"), (4, None), (5, "2.0")]
    res = spark.createDataFrame([("u", "1.2.3"), ("u", "1.2.10"), ("u", "2.0.0-rc"), ("w", None)], "url string, version string")
    want = spark.createDataFrame([(x,) for x in ("u", "u|1.2", "u|1.2.7", "u|1.2.3", "u|3.0", "w", None)], "canonical string")
    assert rows(vv.resolved(want, res)) == [("u", "u", "2.0.0-rc"), ("u|1.2", "u", "1.2.10"), ("u|1.2.3", "u", "1.2.3"), ("u|1.2.7", "u", "1.2.10"), ("u|3.0", None, None), ("w", "w", None)]


def test_this_or_later(spark):
    cases = [("1.2", "1.2.0", True), ("1.2.0", "1.2", False), ("1.x", "1.0.0", True), ("2.0.0", "1.9.9", False), ("1.0.0-a", "1.0.0", True), ("1.0.0", "1.0.0-a", False), ("R4", "4.0.1", True), ("r5", "R4B", False), ("x y", "1.0", None), (None, "1.0", None)]
    t = spark.createDataFrame(cases, "c string, v string, want boolean")
    assert t.filter(~versions.this_or_later(F.col("c"), F.col("v")).eqNullSafe(F.col("want"))).count() == 0


def test_preorder(spark):
    codes = spark.createDataFrame([(c, c != "b") for c in "abcdefg"], "code string, live boolean")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("f", "g"), ("g", "f"), (None, "a"), ("a", None)], "parent string, child string")
    got = [tuple(r) for r in ds.preorder(edges, codes, F.col("live")).orderBy("place").collect()]
    assert got == [("a", None, 0, 1), ("c", "a", 1, 2), ("d", "a", 1, 3), ("e", None, 0, 4)]  # f and g are a circle that no root leads to
    assert ds.preorder(edges.limit(0), codes.limit(0), F.col("live")).count() == 0


def test_displays(spark):
    d = spark.createDataFrame([("a", "de", None, "eins", True, 1), ("a", "de-CH", "display", "zwei", True, 2), ("a", None, None, "one", False, 3), ("a", "fr", "synonym", "un", True, 4), ("b", None, None, None, True, 5)], "code string, lang string, use string, value string, active boolean, ord int")
    assert rows(ds.display_counts(d.filter("lang IS NOT NULL"), ["de-CH"])) == [("a", 1)]
    assert rows(ds.display_counts(d.filter("lang IS NOT NULL"), ["de-AT"])) == [("a", 2)]
    assert rows(ds.allowed_displays(d, [])) == [("a", "eins|zwei")]
    assert [r["value"] for r in ds.chosen_designations(d, ["fr"]).collect()] == ["un"]
    assert ds.chosen_designations(d, []).count() == 5
    w = spark.createDataFrame([("a", "1.5"), ("b", None), ("c", "x")], "code string, weight string")
    more = spark.createDataFrame([("b", "2", 2), ("b", "3", 1), ("a", "9", 1)], "code string, weight string, ord int")
    assert [(r[0], None if r[1] is None else float(r[1])) for r in ds.weights(w, more).orderBy("code").collect()] == [("a", 1.5), ("b", 3.0), ("c", None)]


def test_providers(spark):
    assert pv.takes("currency", "decimals", "equals") and not pv.takes("currency", "decimals", "=")
    with pytest.raises(ValueError):
        pv.system_filter("country", "code", "=", "x")
    m = spark.createDataFrame([("text/plain; q=1",), ("text",), ("/x",), (None,)], "x string").select(pv.media_type(F.col("x")).alias("m"), pv.as_boolean(F.col("x")).alias("b")).select("m.type", "m.valid")
    assert rows(m) == rows(spark.createDataFrame([("text", True), ("", False), ("", False), ("", False)], "type string, valid boolean"))
    j = spark.createDataFrame([('{"a": 1, "valueCode": "x"}',), ("{}",), ("no json",), (None,)], "x string")
    assert [r[0] for r in j.select(pv.value_name(F.col("x"))).collect()] == ["valueCode", None, None, None]
    assert units.fault("mg/dL") is None and units.fault("[degF]") is None and units.fault("foo") and units.fault(None)
    assert units.search("in_i") == ["[in_i]"] and "[degF]" in units.search("^.deg", regex=True)


def test_registry(spark):
    dates = ["Mon, 5 Feb 2024 10:00:00 +0100", "5 Feb 2024 09:00:00", "2024-02-05", "2024-02-05T09:00:00Z", "never", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in dates], "x string").select(rg.published_at(F.col("x")).cast("string")).collect()]
    assert got == ["2024-02-05 09:00:00", "2024-02-05 09:00:00", "2024-02-05 00:00:00", "2024-02-05 09:00:00", None, None]
    t = datetime.datetime(2024, 1, 1)
    feed = spark.createDataFrame([("g", t, "a"), ("g", t, "b"), (None, t, "c"), ("k", t, "d")], "guid string, published timestamp, name string")
    assert [r["name"] for r in rg.new_items(feed, spark.createDataFrame([("k",)], "guid string")).collect()] == ["b"]
    p = spark.createDataFrame([("n", "1", t, None, None), ("n", "2", t, "said", 3)], "name string, version string, published timestamp, description string, downloads int")
    assert rows(rg.package_versions(p).select("version", "is_latest", "description", "downloads")) == [("1", False, "said", 0), ("2", True, "said", 3)]
    with pytest.raises(ValueError):
        rg.search_order("title")


def test_definitions(spark):
    pairs = spark.createDataFrame([("big", "small")], "ancestor string, descendant string")
    rels = spark.createDataFrame([("p", 1, "r", "big"), ("q", 2, "r", "small"), ("q", 2, "s", "x"), ("w", 0, "r", "small"), ("w", 0, "r", "big")], "source string, grp int, rel string, target string")
    req = spark.createDataFrame([("p", "q"), ("q", "p"), ("none", "p"), ("p", "none")], "code_a string, code_b string")
    assert rows(df.subsumed(req, rels, pairs)) == [("none", "p", True), ("p", "none", False), ("p", "q", True), ("q", "p", False)]
    assert rows(df.narrowest(rels, pairs).filter("source = 'w'")) == [("w", 0, "r", "small")]
    assert df.implicit_set("s?fhir_vs=isa/1", "s") == ("isa", "1") and df.implicit_set("s?fhir_vs", "s") == ("all", None)
    with pytest.raises(ValueError):
        df.implicit_set("s?fhir_vs=odd/1", "s")
    with pytest.raises(ValueError):
        df.implicit_map("s?fhir_cm=1", "s", spark.createDataFrame([], "refset string, code string, target string"))


def test_state(spark):
    state = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(1, "x", "changed", 1), (1, None, "deleted", 2), (3, "c", "added", 1)], "id int, v string, change string, at int")
    assert rows(sync.applied(state, changes, "id", "at")) == [(2, "b"), (3, "c")]
    assert rows(sync.history(state, spark.createDataFrame([(2, "z"), (4, "d"), (4, "d")], "id int, v string"), ["id"])) == [(1, "a"), (2, "b"), (4, "d")]
    walk = h.closure_by_system(spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("t", "c", "d"), ("t", None, "d")], "system string, parent string, child string"))
    assert rows(walk) == [("s", "a", "b", 1), ("s", "a", "c", 2), ("s", "b", "c", 1), ("t", "c", "d", 1)]
