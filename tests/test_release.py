"""Small cases of filters on versioned sets, translation with products, the older classification's text, and units: nulls, ties, empty tables and errors."""

import json
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.functions import decimals, text, units
from tessera.operators import catalogues as cat
from tessera.operators import maps
from tessera.operators import versioned as vv
from tessera.sources import releases, resources

CONCEPTS = [("s", "1", "a", "A"), ("s", "1", "b", "B"), ("s", "1", "c", "C"), ("s", "2", "a", "A"), ("s", "1", None, None)]
PAIRS = [("s", "a", "b", 1), ("s", "a", "c", 2), ("s", "b", "c", 1)]
PROPS = [("s", "p", "x", "a"), ("s", "p", None, "b"), ("s", "q", "y", "b"), ("s", None, "x", "c")]


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def expanded(spark, sets, depth=", depth int"):
    """The codes of each set (name, filters), all expanded in one job."""
    vs = lambda name, fs: {"resourceType": "ValueSet", "url": name, "compose": {"include": [{"system": "s", "version": "1", "filter": [dict(zip(("property", "op", "value"), f, strict=True)) for f in fs]}]}}
    clauses = resources.value_set_clauses(spark.createDataFrame([(json.dumps(vs(*x)),) for x in sets], "json string"))
    concepts = spark.createDataFrame(CONCEPTS, "system string, version string, code string, display string")
    walks = spark.createDataFrame([p if depth else p[:3] for p in PAIRS], f"system string, ancestor string, descendant string{depth}")
    out = dict.fromkeys((x[0] for x in sets), "")
    for r in sorted(vv.expanded(clauses, concepts, walks, spark.createDataFrame(PROPS, "system string, prop string, value string, code string")).collect(), key=lambda r: r.code):
        out[r.vset] += r.code
    return out


def test_filters(spark):
    cases = [
        ([("concept", "is-not-a", "b")], "a"), ([("concept", "child-of", "a")], "b"), ([("concept", "descendent-leaf", "a")], "c"), ([("concept", "generalizes", "b")], "ab"),
        ([("concept", "is-not-a", "zz")], "abc"), ([("concept", "regex", "a|c")], "ac"), ([("concept", "exists", "false")], ""), ([("child", "exists", "true")], "ab"), ([("child", "exists", "false")], "c"),
        ([("p", "not-in", "x,z")], "bc"), ([("p", "regex", "x|y")], "a"), ([("p", "exists", "true")], "ab"), ([("p", "exists", "false")], "c"), ([("concept", "is-a", "a"), ("p", "=", "x")], "a"),
        ([("p", "in", "x"), ("p", "not-in", "x")], ""), ([("concept", "not-in", "a"), ("concept", "is-a", "b")], "bc"),
    ]
    assert expanded(spark, [(f"v{k}", f) for k, (f, _) in enumerate(cases)]) == {f"v{k}": want for k, (_, want) in enumerate(cases)}


def test_filter_errors(spark):
    for f in (("concept", "regex", r"(a)\1"), ("p", "is-a", "a"), ("concept", "like", "a"), ("p", "=", None), ("p", None, "x")):
        with pytest.raises(ValueError):
            expanded(spark, [("v", [f])])
    with pytest.raises(ValueError):
        expanded(spark, [("v", [("concept", "child-of", "a")])], depth="")


def concept_map(url, *groups, **more):
    return json.dumps({"resourceType": "ConceptMap", "url": url, "group": [{"source": s, "target": t, "element": e} for s, t, e in groups]} | more)


def translations(spark, requests, *texts, reverse=False):
    r = spark.createDataFrame(requests, "req_id long, system string, version string, code string, scope string, to_system string, products string")
    return rows(maps.translated(r, resources.mappings(spark.createDataFrame([(t,) for t in texts], "json string")), reverse).select("req_id", "map", "system", "code", "comment"))


def test_translated(spark):
    to = lambda code, kind, **more: {"code": code, "relationship": kind} | more
    one = concept_map("m", ("s|1", "t", [{"code": "a", "target": [to("x", "equivalent", comment="first"), to("x", "related-to", comment="second"), to("y", "not-related-to"), {"code": "z"}, to("w", None, equivalence="wider")]}, {"code": "b"}, {"target": []}]))
    scoped = concept_map("n", ("other", "u", [{"code": "a", "target": [to(None, "equivalent")]}]), targetScopeUri="vs")
    ask = lambda *x: tuple(x) + ("clash",)
    assert translations(spark, [ask(1, "s", "1", "a", None, None)] * 2, one, scoped) == [(1, "m", "t", "w", None), (1, "m", "t", "x", "first")]
    assert translations(spark, [ask(1, "s", None, "a", None, None), ask(2, "s", "2", "a", None, None), ask(3, "s", "1", None, None, None), ask(4, "s", "1", "a", None, "u"), ask(5, None, None, "a", None, None)], one, scoped) == []
    assert translations(spark, [ask(1, None, None, "a", "vs|9", None)], one, scoped) == [(1, "n", "u", None, None)]
    assert translations(spark, [ask(1, "t", None, "x", None, "s|1"), ask(2, "t", None, "x", None, "s")], one, reverse=True) == [(1, "m", "s|1", "a", "first")]
    assert translations(spark, [], one) == [] and translations(spark, [ask(1, "s", "1", "a", None, None)]) == []
    assert translations(spark, [ask(1, "s", "1", "a", None, None)], "not json", "{}", '{"resourceType": "ConceptMap"}') == []


def test_classification_text(spark):
    whole = "dropped\nXVII. ALL  OF IT (800-999)\nE. BY CAUSE (E800-E999)\n\nINJURY (800-829)\n  excludes: burns\n   other\n Includes:\n a  b\n801  Fall\n note: x\n801.0\tLow\n801.01 Lower\n801.5x not a code\nV01 Contact\n801.0 Again"
    frame = spark.createDataFrame([("f", whole), ("g", None), ("h", ""), ("i", "no header"), ("j", "801.1 Alone")], "path string, text string")
    got = {(r.path, r.ord): r for r in releases.classification_text(frame).collect()}
    assert [(got["f", k].code, got["f", k].parent_code) for k in range(1, 9)] == [
        ("800-999", None), ("E800-E999", "800-999"), ("800-829", "800-999"), ("801", "800-829"), ("801.0", "801"), ("801.01", "801.0"), ("V01", None), ("801.0", "801"),
    ]
    assert got["f", 1].display == "ALL OF IT" and got["f", 1].is_group and not got["f", 4].is_group
    assert (got["f", 3].excludes, got["f", 3].includes, got["f", 3].note) == ("burns other", "a b", None) and got["f", 4].note == "x" and got["f", 6].description == "801.5x not a code"
    assert got["j", 1].parent_code is None and len(got) == 9


def test_units():
    assert units.reduced("10*3/uL{cells}") == (Fraction(10**12), "m-3") and units.reduced("J/(kg.K)") == (Fraction(1), "K-1 m2 s-2")
    assert units.reduced("mm[Hg]")[0] == Fraction(133322) and units.reduced("[iU]/mL")[1] == "[iU]1 m-3" and units.reduced("{rbc}") == (1, "") and units.reduced("KiBy")[0] == 8192
    for bad in ("(m", "m)", "m//s", "m.", "5/0", "m{a}{b}", "m 2", "m99999", "{a", "kmin"):
        assert units.reduced(bad) is None and units.fault(bad)


def test_units_too_large(spark):
    r = spark.createDataFrame([(1, 2.0, "Ym500", "Ym500"), (2, 2.0, "kcal", "[Cal]"), (3, None, "m", None)], "id long, value double, source string, target string")
    assert [(x[0], x[4]) for x in rows(units.converted(r))] == [(1, None), (2, 2.0), (3, None)]


def test_decimals(spark):
    cases = {
        ("1", "+", "1"): "2", ("5", "+", "-6"): "-1", ("0", "-", "2"): "-2", ("2", "*", "0.5"): "1", ("20", "*", "20"): "400", ("1.50", "*", "2.0"): "3.0", ("2", "*", "-2"): "-4", ("0", "*", "1.00"): "0",
        ("1", "/", "8"): "0.125", ("400", "/", "20"): "20", ("1", "/", "3"): "0.3", ("2.00", "/", "3"): "0.667", ("1000.0", "/", "3.0"): "333", ("-0", "+", "0"): "0", ("1e2", "*", "1e-1"): "10", ("0.1", "+", "0.2"): "0.3",
        ("123456789012345678901234567890", "*", "10"): "1234567890123456789012345678900", ("1", "/", "0"): None, ("", "+", "1"): None, (".", "+", "1"): None, ("1.", "+", "1"): None, (None, "+", "1"): None, ("1", "^", "1"): None, ("1", None, "1"): None, ("1e999", "+", "1"): None,
    }
    assert {k: (decimals.calculated(*k) or (None,))[0] for k in cases} == cases
    assert decimals.calculated("1", "/", "8")[1] == 100 and decimals.calculated("1.50", "*", "2.0")[1] == 2 and decimals.number("0.00")[1] == 2 and decimals.number("-0.010")[1] == 2
    frame = spark.createDataFrame([(1, "2", "*", "3", "clash"), (2, None, "*", "3", None)], "id int, a string, op string, b string, digits string")
    assert rows(decimals.with_results(frame).select("id", "result", "digits")) == [(1, "6", 1), (2, None, None)] and decimals.with_results(frame.limit(0)).count() == 0


def test_catalogue_tables(spark):
    make = spark.createDataFrame
    users = make([(1, "u1", None, 4), (2, None, "n", 9), (3, "u3", "x", None)], "user_id int, user_url string, user_name string, version int")
    uses = make([(1, 1), (1, 1), (1, 2), (None, 3), (2, None)], "def_id int, user_id int")
    got = cat.extension_examples(make([(1, "e"), (2, None)], "def_id int, url string"), uses, users)
    assert rows(got) == sorted([("e", "u1", None, "R4"), ("e", "u1", None, "R4"), ("e", None, "n", "9")], key=repr)
    profiles = make([(1, "Patient", "p", None), (9, "Patient", "q", "t"), (None, None, None, None)], "package_id int, resource_type string, url string, title string")
    assert rows(cat.profiles_by_package(profiles, make([(1, "a", None)], "package_id int, name string, version string"))) == [("Patient", "p", "", "a#")]
    flags = make([("true",), ("True",), ("",), (None,)], "x string").select(text.flag(F.col("x"), True))
    assert [r[0] for r in flags.collect()] == [True, False, True, True]
    sets = make([('{"resourceType": "ValueSet", "url": "u", "compose": {"lockedDate": "2020"}}',), ("no json",), (None,), ('{"resourceType": "ValueSet"}',)], "json string")
    assert rows(resources.locked(sets)) == [("u", None, "2020")]
    assert rows(units.faults(make([("g", 1), ("g", 2), (None, 3), ("?", 4)], "unit string, fault int"))) == [("?", "the unit ? is not known"), ("g", None), (None, "the unit is empty")]
