from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.functions import stemming, text, units, versions
from tessera.operators import filters as fl
from tessera.plans import composed_queries
from tessera.plans.expansion import Clause, CodeSystem, Filter, ValueSet, expand, resolved_version


def values(spark, col, *rows):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(col(F.col("x"))).collect()]


def test_stems():
    # from the published vocabulary
    pairs = "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat conditional:condit vietnamization:vietnam predication:predic hopefulness:hope triplicate:triplic formalize:formal electrical:electr goodness:good revival:reviv allowance:allow airliner:airlin adjustable:adjust defensible:defens replacement:replac adoption:adopt homologou:homolog effective:effect probate:probat rate:rate cease:ceas controll:control roll:roll"
    assert {p: stemming.stem(p.split(":")[0]) for p in pairs.split()} == {p: p.split(":")[1] for p in pairs.split()}


def test_stem_search(spark):
    rows = [("1", "licenses"), ("2", "version"), ("2", "license"), ("3", "other")]
    index = stemming.stem_index(spark.createDataFrame(rows, "key string, word string"))
    assert sorted(tuple(r) for r in stemming.search(index, "licensing versions").collect()) == [("1", 1), ("2", 2)]
    assert [r["key"] for r in stemming.search(index, "licensing versions", every=True).collect()] == ["2"]
    assert composed_queries.stem_search(spark, "/root/testdata/sf0.001").count() > 0


def test_units():
    assert units.reduced("mg/dL") == (Fraction(10), "g1 m-3") and units.reduced("kg.m/s2") == (Fraction(1000), "g1 m1 s-2")
    assert units.reduced("/min") == (Fraction(1, 60), "s-1") and units.reduced("10.m")[0] == 10
    assert units.reduced("foo") is None and units.reduced("") is None and units.reduced("kmin") is None


def test_versions(spark):
    assert values(spark, versions.kind, "20240101", "3", "1.2.3-a", "2024-02", "x y", None)[:5] == ["date", "integer", "semver", "date", "natural"]
    assert values(spark, versions.major_minor, "2.1.3-beta", "4", "1.0") == ["2.1", "4.0", "1.0"]
    fits = lambda p: lambda c: versions.matches(c, F.lit(p))
    assert values(spark, fits("1.x"), "1.4.2", "1.4", "2.0.0", "1.4.2-rc") == [True, True, False, False]
    assert values(spark, fits("1.4?"), "1.4.2", "1.5", "1.40") == [True, False, True]
    got = spark.createDataFrame([(v,) for v in ["1.10.0", "1.2.0", "1.2.0-rc", "1.2"]], "v string").orderBy(versions.semver_key(F.col("v")), "v").collect()
    assert [r[0] for r in got] == ["1.2.0-rc", "1.2", "1.2.0", "1.10.0"]
    assert [tuple(x) for x in values(spark, versions.canonical, "http://a|1", "http://a", "a|b|2", "a|")] == [("http://a", "1"), ("http://a", None), ("a|b", "2"), ("a", None)]


def test_texts(spark):
    assert values(spark, lambda c: text.language_match(c, "en-US"), "en-US", "en-us", "en", "en-GB", "de", None) == [3, 3, 1, 1, 0, 0]
    assert values(spark, lambda c: text.language_part(c, "script"), "zh-Hans-CN", "zh-CN") == ["Hans", None]
    assert values(spark, lambda c: text.display_difference(c, F.lit("Ab c")), "Ab c", "ab C", " ab  c", "x") == ["same", "case", "space", "other"]
    assert values(spark, text.ndc_code11, "2-14-8", "1-2", None, "", "123456-7-89") == ["00002001408", "00000000012", "", "", "123456000789"]
    assert [str(x) for x in values(spark, text.repaired_date, "23880101", "20200230", "abc", None)] == ["2018-01-01", "None", "None", "None"]
    assert [[tuple(y) for y in x] for x in values(spark, text.language_preferences, "en;q=0.5, de, fr;q=0.9", "")] == [[("de", 1.0), ("fr", 0.9), ("en", 0.5)], []]
    assert [tuple(x) for x in values(spark, text.modified_code, "1:a:b", "1:a:a", ":x", "9")] == [("1", ["a", "b"], True), ("1", ["a", "a"], False), ("", ["x"], False), ("9", [], True)]
    with pytest.raises(ValueError):
        fl.matches("value", r"(a)\1")


def test_definitions(spark):
    concepts = spark.createDataFrame([(c, c.upper()) for c in "abcde"], "code string, display string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d")], "parent string, child string")
    props = spark.createDataFrame([("b", "p", "1"), ("c", "p", "2"), ("d", "q", "1")], "code string, prop string, value string")
    s = CodeSystem(concepts, edges, props, inactive=concepts.filter("code = 'd'").select("code"))
    got = lambda *f, **k: sorted(r["code"] for r in expand("x", {"x": ValueSet((Clause(filters=f),), **k)}, s).collect())
    assert got(Filter("concept", "is-a", "b")) == ["b", "c"] and got(Filter("concept", "is-not-a", "b")) == ["a", "d", "e"]
    assert got(Filter("concept", "descendent-leaf", "a")) == ["c", "d"] and got(Filter("concept", "generalizes", "c")) == ["a", "b"]
    assert got(Filter("p", "not-in", "1")) == ["c", "d"]  # a and e have no property at all
    assert got(Filter("p", "exists", "false")) == ["a", "d", "e"] and got(Filter("child", "exists", "false")) == ["c", "d", "e"]
    assert got(Filter("p", "regex", "[12]"), Filter("concept", "descendent-of", "b")) == ["c"]
    assert got(keep_inactive=False) == ["a", "b", "c", "e"]
    loop = {"x": ValueSet((Clause(imports=("y",)),)), "y": ValueSet((Clause(imports=("x",)),))}
    with pytest.raises(ValueError, match="imports itself"):
        expand("x", loop, s)
    with pytest.raises(ValueError, match="not supported"):
        got(Filter("p", "near", "1"))
    assert resolved_version("10.0", check="1")[1] is not None and resolved_version("1.0", check="1")[1] is None
    assert resolved_version("1", override="2") == ("2", None) and resolved_version("1.2", check="2.x")[1] is not None


def test_masks_of_more_than_a_thousand_lengths(spark):
    from tessera.operators import catalogues

    rules = spark.createDataFrame([(n, "x" * n + "*", n % 2 == 1) for n in range(1300, 0, -1)] + [(5000, "*", False)], "ord int, mask string, allowed boolean")
    values = spark.createDataFrame([("x" * n,) for n in (1, 2, 700, 1299, 1300)] + [("y",), (None,)], "v string")
    assert catalogues.masked(values, rules.select("mask"), "v").count() == 1 + 2 + 700 + 1299 + 1300 + 6
