"""Value sets over several systems and versions: whole tables of definitions are resolved, expanded and checked in one job.

``concepts`` is (system, version, code, display). ``clauses`` is what ``sources.resources.value_set_clauses`` gives: (url, version, kind, clause_ord,
system, system_version, concepts, filters, imports). A set is named by ``url|version``, or by its url if it has no version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import versions
from tessera.operators.filters import LOOKS_BACK
from tessera.session import settled


def order_of(version: str) -> Column:
    """A total order of version texts: semantic versions by their parts, others by their text; null is the oldest."""
    return F.struct(versions.semver_key(F.col(version)).alias("k"), F.col(version).alias("v"))


def named(url: str = "url", version: str = "version") -> Column:
    return F.concat_ws("|", url, version)


def newest(rows: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(version, order_of(version)).alias(version))


def version_keys(resources: DataFrame) -> DataFrame:
    """(key, url, version): each resource by url|version, the newest of a major.minor by url|major.minor, the newest of all by its url; an exact key goes first."""
    r = resources.select("url", "version").distinct()
    exact = r.filter("version IS NOT NULL").select(named().alias("key"), "url", "version", F.lit(0).alias("rank"))
    mm = r.filter(versions.kind(F.col("version")) == "semver").withColumn("mm", versions.major_minor(F.col("version")))
    minor = newest(mm, ["url", "mm"]).select(F.concat_ws("|", "url", "mm").alias("key"), "url", "version", F.lit(1).alias("rank"))
    bare = newest(r, ["url"]).select(F.col("url").alias("key"), "url", "version", F.lit(2).alias("rank"))
    rows = exact.unionByName(minor).unionByName(bare)
    return rows.groupBy("key").agg(F.min_by(F.struct("url", "version"), "rank").alias("b")).select("key", "b.url", "b.version")


def resolved(wanted: DataFrame, resources: DataFrame) -> DataFrame:
    """(canonical, url, version): what each canonical names, by its own version, else by its major.minor; nulls if nothing fits."""
    c = versions.canonical(F.col("canonical"))
    w = wanted.select("canonical").filter("canonical IS NOT NULL").distinct()
    minor = F.when(versions.kind(c["version"]) == "semver", F.concat_ws("|", c["url"], versions.major_minor(c["version"])))
    tries = w.select("canonical", F.posexplode(F.array("canonical", minor)).alias("n", "key")).filter("key IS NOT NULL")
    hit = tries.join(version_keys(resources), "key").groupBy("canonical").agg(F.min_by(F.struct("url", "version"), "n").alias("b"))
    return w.join(hit, "canonical", "left").select("canonical", "b.url", "b.version")


def pinned(canonicals: DataFrame, rules: DataFrame) -> DataFrame:
    """(canonical, pinned): canonicals with the version that the rules (system, override, fallback, check) name for their url, else as they are."""
    c = canonicals.select("canonical", versions.canonical(F.col("canonical")).alias("c")).select("canonical", F.col("c.url").alias("system"), F.col("c.version").alias("stated"))
    out = c.join(rules, "system", "left")
    return out.select("canonical", F.concat_ws("|", "system", F.coalesce("override", "stated", "fallback", "check")).alias("pinned"))


def chosen(clauses: DataFrame, concepts: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Clauses with ``used``, the version that they read, and ``complaint``.

    Override goes before the stated version, then default, then check; the newest version that fits is read, of all if none is asked for. ``used`` is
    null if no version fits. A version that the check doesn't fit is read, with a complaint.
    """
    ask = ["override", "fallback", "check"]
    c = clauses.join(rules.select("system", *ask), "system", "left") if rules is not None else clauses.select("*", *[F.lit(None).cast("string").alias(x) for x in ask])
    c = c.withColumn("wanted", F.coalesce("override", "system_version", "fallback", "check"))
    have = concepts.select("system", F.col("version").alias("have")).distinct()
    fits = F.col("wanted").isNull() | (F.col("have") == F.col("wanted")) | versions.matches(F.col("have"), F.col("wanted"))
    fit = c.select("system", "wanted").distinct().join(have, "system").filter(fits)
    best = fit.groupBy("system", "wanted").agg(F.max_by("have", F.struct(F.col("have").eqNullSafe(F.col("wanted")).alias("exact"), order_of("have").alias("o"))).alias("used"))
    best = best.select(F.col("system").alias("s"), F.col("wanted").alias("w"), "used")
    complaint = F.when(F.col("check").isNotNull() & F.col("wanted").isNotNull() & ~versions.matches(F.col("wanted"), F.col("check")), F.concat(F.lit("version "), "wanted", F.lit(" does not fit "), "check"))
    out = c.join(best, (F.col("system") == F.col("s")) & F.col("wanted").eqNullSafe(F.col("w")), "left")
    return out.withColumn("complaint", complaint).drop("s", "w", "wanted", *ask)


def other_versions_only(clauses: DataFrame) -> DataFrame:
    """(vset) of sets that exclude other versions only: one system, every clause with a version, no version on both sides. Their excludes remove codes of their own version."""
    v = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("system_version")))
    g = clauses.groupBy(named().alias("vset")).agg(
        F.count_distinct("system").alias("n"), F.count_if(F.col("system").isNull() | F.col("system_version").isNull()).alias("bare"), v("include").alias("i"), v("exclude").alias("e")
    )
    return g.filter((F.col("n") == 1) & (F.col("bare") == 0) & (F.size("i") > 0) & (F.size("e") > 0) & ~F.arrays_overlap("i", "e")).select("vset")


#: Operators of filters, on the concept itself and on a property; others are refused.
CONCEPT_OPS = ["=", "in", "not-in", "is-a", "is-not-a", "descendent-of", "descendent-leaf", "child-of", "generalizes", "regex", "exists"]
PROPERTY_OPS = ["=", "in", "not-in", "regex", "exists"]


def _filters(clauses: DataFrame, keys: list) -> DataFrame:
    """Filters one a row with ``on`` (concept, child or property), the positive operator ``op``, ``negated``, and ``one``, each value that it lists."""
    f = clauses.select(*keys, F.posexplode("filters").alias("p", "f")).select(*keys, (F.col("p") + 1).alias("k"), "f.property", F.col("f.op").alias("stated"), "f.value")
    on = F.when(F.col("property").isin("concept", "code"), "concept").when((F.col("property") == "child") & (F.col("stated") == "exists"), "child").otherwise("property")
    op = F.when(F.col("stated") == "not-in", "in").when(F.col("stated") == "is-not-a", "is-a").otherwise(F.col("stated"))
    negated = F.col("stated").isin("not-in", "is-not-a") | ((F.col("stated") == "exists") & (F.col("value") == "false"))
    values = F.when(op == "in", F.transform(F.split("value", ","), lambda x: F.trim(x))).otherwise(F.array("value"))
    return f.select(*keys, "k", "property", on.alias("on"), op.alias("op"), negated.alias("negated"), F.explode(values).alias("one"))


def _conditions(c: DataFrame, concepts: DataFrame, pairs: DataFrame, props: DataFrame) -> DataFrame:
    """(vset, kind, clause_ord, k, system, used, code): codes that fulfil condition k of a clause. Condition 0 is the list, the others are filters; a negated one is what its opposite leaves of the system's version."""
    key = ["vset", "kind", "clause_ord", "system", "used"]
    listed = c.select(*key, F.explode("concepts").alias("x")).select(*key, F.lit(0).alias("k"), F.col("x.code").alias("code"))
    f = settled(_filters(c, key))
    on = lambda what, *ops: f.filter((F.col("on") == what) & F.col("op").isin(*ops))
    code = concepts.select("system", F.col("version").alias("used"), "code").filter("code IS NOT NULL").distinct()
    over = pairs.select("system", F.col("ancestor").alias("one"), F.col("descendant").alias("code"))
    parents = pairs.select("system", F.col("ancestor").alias("code")).distinct()
    has = props.select("system", F.col("prop").alias("property"), "value", "code")
    whole = F.concat(F.lit("^(?:"), "one", F.lit(")$"))
    parts = [
        on("concept", "is-a", "descendent-of").join(over, ["system", "one"]),
        on("concept", "descendent-leaf").join(over.join(parents, ["system", "code"], "left_anti"), ["system", "one"]),
        on("concept", "generalizes").join(pairs.select("system", F.col("descendant").alias("one"), F.col("ancestor").alias("code")), ["system", "one"]),
        on("concept", "is-a", "generalizes", "=", "in").withColumn("code", F.col("one")),
        on("concept", "regex").join(code, ["system", "used"]).filter(F.rlike("code", whole)),
        on("concept", "exists").join(code, ["system", "used"]),
        on("child", "exists").join(parents, "system"),
        on("property", "=", "in").join(has.withColumnRenamed("value", "one"), ["system", "property", "one"]),
        on("property", "regex").join(has, ["system", "property"]).filter(F.rlike("value", whole)),
        on("property", "exists").join(has, ["system", "property"]),
    ]
    if "depth" in pairs.columns:
        parts.append(on("concept", "child-of").join(pairs.filter("depth = 1").select("system", F.col("ancestor").alias("one"), F.col("descendant").alias("code")), ["system", "one"]))
    cols = [*key, "k", "code"]
    hits = reduce(DataFrame.unionByName, [x.select(*cols, "negated") for x in parts])
    asked = f.filter("negated").select(*key, "k", "on").distinct().join(code, ["system", "used"])
    bare = asked.filter("on = 'property'").join(props.select("system", "code").distinct(), ["system", "code"], "left_anti").select(*cols).join(f.filter("op = 'in'").select(*key, "k").distinct(), [*key, "k"], "left_semi")
    rest = asked.select(*cols).join(hits.filter("negated").select(*cols), cols, "left_anti").join(bare, cols, "left_anti")
    return listed.select(*cols).unionByName(hits.filter("NOT negated").select(*cols)).unionByName(rest).distinct()


def expanded(clauses: DataFrame, concepts: DataFrame, pairs: DataFrame, props: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(vset, system, version, code, display, clause_ord) of every set in the table: the first include that gave a code, without the excludes.

    All conditions of a clause have to hold; a clause without any takes its whole system. Filters: ``CONCEPT_OPS`` on the concept (``pairs`` is
    (system, ancestor, descendant), for child-of with its depth), ``PROPERTY_OPS`` on a property (``props`` is (system, prop, value, code)), and exists on ``child``.
    not-in holds for codes with some property, exists takes true or false, regex fits the whole text. Imports are taken in rounds, one for each level
    of nesting. Sets that import themselves or what isn't there, and filters of other kinds, are errors. A clause whose system has no fitting version gives nothing.
    """
    c = settled(chosen(clauses, concepts, rules).withColumn("vset", named()))
    concept_ops = [x for x in CONCEPT_OPS if x != "child-of" or "depth" in pairs.columns]
    bad = lambda f: ~F.coalesce(F.when(f["property"].isin("concept", "code"), f["op"].isin(concept_ops)).otherwise(f["op"].isin(PROPERTY_OPS)) & f["value"].isNotNull() & ((f["op"] != "regex") | ~f["value"].rlike(LOOKS_BACK)), F.lit(False))
    if c.filter(F.exists("filters", bad)).take(1):
        raise ValueError("a filter has an operator or a value that is not supported")
    imports = c.select("vset", "kind", "clause_ord", F.explode("imports").alias("canonical")).distinct()
    names = resolved(imports, clauses).select("canonical", F.when(F.col("url").isNotNull(), named()).alias("target"))
    imports = settled(imports.join(names, "canonical"))
    nested = bool(imports.take(1))
    if imports.filter("target IS NULL").take(1):
        raise KeyError("an imported value set is not known")

    n_imports = imports.groupBy("vset", "kind", "clause_ord").agg(F.count("*").alias("n_imports"))
    needed = c.join(n_imports, ["vset", "kind", "clause_ord"], "left").withColumn("n_imports", F.coalesce("n_imports", F.lit(0)))
    size = lambda x: F.when(F.col(x).isNull(), 0).otherwise(F.size(x))
    own = size("filters") + F.when(size("concepts") > 0, 1).otherwise(0)
    needed = needed.withColumn("needed", own + F.col("n_imports"))
    conditions = settled(_conditions(c.filter("used IS NOT NULL"), concepts, pairs, props))
    strict = other_versions_only(clauses).withColumn("by_version", F.lit(True))
    code = concepts.select("system", F.col("version").alias("used"), "code").distinct()
    key = ["vset", "kind", "clause_ord"]

    done, left = None, settled(c.select("vset").distinct())
    while left.take(1):
        waits = imports.join(left.select(F.col("vset").alias("target")), "target", "left_semi")
        ready = settled(left.join(waits.select("vset").distinct(), "vset", "left_anti")) if nested else left
        if nested and not ready.take(1):
            raise ValueError("value sets import one another in a circle")
        now = needed.join(ready, "vset", "left_semi")
        whole = now.filter((F.col("needed") == 0) & F.col("used").isNotNull()).select(*key, "system", "used").join(code, ["system", "used"])
        rows = conditions.join(ready, "vset", "left_semi").select(*key, F.col("k").cast("string").alias("k"), "system", "used", "code")
        if done is not None:
            brought = imports.join(ready, "vset", "left_semi").join(done.select(F.col("vset").alias("target"), "system", F.col("version").alias("used"), "code"), "target")
            rows = rows.unionByName(brought.select(*key, F.concat(F.lit("i"), "target").alias("k"), "system", "used", "code"))
        met = rows.groupBy(*key, "system", "used", "code").agg(F.count("*").alias("n")).join(now.select(*key, "needed"), key).filter("n = needed")
        members = met.select(*key, "system", "used", "code").join(code, ["system", "used", "code"], "left_semi").unionByName(whole.select(*key, "system", "used", "code"))
        members = members.join(strict, "vset", "left").withColumn("mark", F.when(F.col("by_version"), F.col("used")).otherwise(""))
        took = members.filter("kind = 'include'").groupBy("vset", "system", "used", "code", "mark").agg(F.min("clause_ord").alias("clause_ord"))
        kept = took.join(members.filter("kind = 'exclude'").select("vset", "system", "mark", "code").distinct(), ["vset", "system", "mark", "code"], "left_anti")
        kept = settled(kept.select("vset", "system", F.col("used").alias("version"), "code", "clause_ord"))
        done = kept if done is None else done.unionByName(kept)
        if not nested:
            break
        left = settled(left.join(ready, "vset", "left_anti"))
    return done.join(concepts.groupBy("system", "version", "code").agg(F.min("display").alias("display")), ["system", "version", "code"])


def totals(expansion: DataFrame, unclosed: DataFrame) -> DataFrame:
    """(vset, total): the number of codes, or null for a set that draws on a system which can't be listed in full (``unclosed`` holds such systems)."""
    open_ = unclosed.select("system").distinct().withColumn("open", F.lit(True))
    g = expansion.groupBy("vset", "system").agg(F.count("*").alias("n")).join(open_, "system", "left")
    return g.groupBy("vset").agg(F.when(~F.coalesce(F.bool_or("open"), F.lit(False)), F.sum("n")).alias("total"))


def content_state(clauses: DataFrame, systems: DataFrame) -> DataFrame:
    """(vset, system, state) of each system that a set names: closed, unclosed (fragments, examples and grammars), or why it can't be read. ``systems`` has (system, content, grammar)."""
    s = clauses.filter("system IS NOT NULL").select(named().alias("vset"), "system").distinct().join(systems.select("system", "content", "grammar").distinct(), "system", "left")
    state = (
        F.when(F.col("content").isNull(), "unknown-system").when(F.col("content") == "supplement", "is-a-supplement").when(F.col("content") == "not-present", "no-content")
        .when(F.col("grammar") | F.col("content").isin("fragment", "example"), "unclosed").otherwise("closed")
    )
    return s.select("vset", "system", state.alias("state"))


def implied_versions(clauses: DataFrame) -> DataFrame:
    """(vset, system, version): the newest version that a set's includes state for a system."""
    inc = clauses.filter("kind = 'include' AND system_version IS NOT NULL").select(named().alias("vset"), "system", F.col("system_version").alias("version"))
    return newest(inc, ["vset", "system"])


def holding_versions(requests: DataFrame, concepts: DataFrame) -> DataFrame:
    """(req_id, version) of (req_id, system, code): null if every version of the system has the code; else the newest that has it, or the newest of all if none has."""
    have = concepts.select("system", "version").distinct()
    c = concepts.select("system", "version", "code").distinct().withColumn("hit", F.lit(True))
    r = requests.select("req_id", "system", "code").join(have, "system").join(c, ["system", "version", "code"], "left")
    g = r.groupBy("req_id").agg(F.count("*").alias("n"), F.count("hit").alias("n_hit"), F.max_by("version", F.struct(F.col("hit").isNotNull().alias("h"), order_of("version").alias("o"))).alias("best"))
    return requests.select("req_id").join(g, "req_id", "left").select("req_id", F.when(F.col("n") != F.col("n_hit"), F.col("best")).alias("version"))


def useful_clauses(requests: DataFrame, clauses: DataFrame) -> DataFrame:
    """(req_id, clause_ord) of (req_id, vset, system, version): includes to look in. A version that the set lists keeps to its clauses; any other, or none, looks in all of its system."""
    inc = clauses.filter("kind = 'include'").select(named().alias("vset"), "clause_ord", "system", "system_version")
    lists = inc.select("vset", F.col("system_version").alias("version")).filter("version IS NOT NULL").distinct().withColumn("listed", F.lit(True))
    r = requests.join(lists, ["vset", "version"], "left").join(inc, ["vset", "system"])
    return r.filter(F.col("listed").isNull() | F.col("system_version").eqNullSafe(F.col("version"))).select("req_id", "clause_ord")


def whole_systems(systems: DataFrame) -> DataFrame:
    """Clauses of the sets that take a whole system each: what codes are checked against if only a system is named."""
    none = lambda t: F.lit(None).cast(t)
    return systems.select(
        F.col("system").alias("url"), "version", F.lit("include").alias("kind"), F.lit(0).alias("clause_ord"), "system", F.col("version").alias("system_version"),
        none("array<struct<code:string,display:string>>").alias("concepts"), none("array<struct<property:string,op:string,value:string>>").alias("filters"), none("array<string>").alias("imports"),
    )


def in_stored(requests: DataFrame, contains: DataFrame) -> DataFrame:
    """(req_id, system, result) of (req_id, vset, system, code) against stored expansions (vset, system, code); without a system the only one that has the code there is taken."""
    c = contains.select("vset", "system", "code").distinct()
    one = c.groupBy("vset", "code").agg(F.count("*").alias("n"), F.min("system").alias("only")).filter("n = 1").select("vset", "code", "only")
    r = requests.join(one, ["vset", "code"], "left").withColumn("system", F.coalesce("system", "only"))
    out = r.join(c.withColumn("hit", F.lit(True)), ["vset", "system", "code"], "left")
    return out.select("req_id", "system", F.coalesce("hit", F.lit(False)).alias("result"))


def tidied(clauses: DataFrame) -> DataFrame:
    """(vset, kind, system, system_version, codes, filters): lists of one system and version made one, codes and filters in order; other clauses as they are."""
    name = [named().alias("vset"), "kind", "system", "system_version"]
    plain = F.col("concepts").isNotNull() & F.col("filters").isNull() & F.col("imports").isNull()
    lists = clauses.filter(plain).select(*name, F.explode("concepts.code").alias("c")).groupBy("vset", "kind", "system", "system_version").agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias("codes"))
    f = F.transform("filters", lambda x: F.concat_ws(" ", x["property"], x["op"], x["value"]))
    rest = clauses.filter(~plain).select(*name, F.array_join(F.array_sort(F.col("concepts.code")), ",").alias("codes"), F.array_join(F.array_sort(f), ",").alias("filters"))
    return lists.withColumn("filters", F.lit(None).cast("string")).unionByName(rest)


def same_clauses(a: DataFrame, b: DataFrame) -> DataFrame:
    """(vset_a, vset_b, form) of the sets of two tables whose tidied clauses are the same."""
    form = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", "kind", "system", F.coalesce("system_version", F.lit("")), F.coalesce("codes", F.lit("")), F.coalesce("filters", F.lit(""))))), "\n"), 256)
    side = lambda x, n: tidied(x).groupBy(F.col("vset").alias(f"vset_{n}")).agg(form.alias("form"))
    return side(a, "a").join(side(b, "b"), "form").select("vset_a", "vset_b", "form")


def several_versions(clauses: DataFrame) -> DataFrame:
    """(vset, system, n): systems of which a set names several versions, so that only expansions can be compared."""
    return clauses.filter("system IS NOT NULL").groupBy(named().alias("vset"), "system").agg(F.count_distinct(F.coalesce("system_version", F.lit(""))).alias("n")).filter("n > 1")


def filter_relations(rows: DataFrame, pairs: DataFrame, many_parents: bool) -> DataFrame:
    """(pair, relation) of single filters (pair, property_a, op_a, value_a, property_b, op_b, value_b): same, left-wider, right-wider, disjoint, or unknown.

    Only is-a filters on one property can differ and still be told apart, by the hierarchy; if codes may have many parents, unrelated ones stay unknown.
    """
    up = pairs.select(F.col("ancestor").alias("value_a"), F.col("descendant").alias("value_b"), F.lit(True).alias("over"))
    down = pairs.select(F.col("descendant").alias("value_a"), F.col("ancestor").alias("value_b"), F.lit(True).alias("under"))
    r = rows.join(up, ["value_a", "value_b"], "left").join(down, ["value_a", "value_b"], "left")
    alike = (F.col("property_a") == F.col("property_b")) & (F.col("op_a") == F.col("op_b"))
    relation = (
        F.when(~alike, "unknown").when(F.col("value_a") == F.col("value_b"), "same").when(F.col("op_a") != "is-a", "unknown")
        .when(F.col("over"), "left-wider").when(F.col("under"), "right-wider").otherwise("unknown" if many_parents else "disjoint")
    )
    return r.select("pair", relation.alias("relation"))


def distinct_includes(clauses: DataFrame) -> DataFrame:
    """(vset, system, system_version, clause_ord): each system and version that a set includes, at its first clause."""
    inc = clauses.filter("kind = 'include' AND system IS NOT NULL").select(named().alias("vset"), "system", F.nullif("system_version", F.lit("")).alias("system_version"), "clause_ord")
    return inc.groupBy("vset", "system", "system_version").agg(F.min("clause_ord").alias("clause_ord"))


def listing(concepts: DataFrame) -> DataFrame:
    """(system, version, n_codes, is_newest): what systems and versions there are."""
    n = concepts.groupBy("system", "version").agg(F.count_distinct("code").alias("n_codes"))
    last = newest(n, ["system"]).select("system", F.col("version").alias("last"))
    return n.join(last, "system").select("system", "version", "n_codes", F.col("version").eqNullSafe(F.col("last")).alias("is_newest"))


def located_codes(requests: DataFrame, concepts: DataFrame) -> DataFrame:
    """(canonical, code, version, display) of (canonical, code): the version that the system's canonical names, or its major.minor, and the code's display there; nulls for what isn't there."""
    systems = concepts.select(F.col("system").alias("url"), "version").distinct()
    at = requests.select("canonical", "code").distinct().join(resolved(requests, systems), "canonical", "left")
    d = concepts.groupBy(F.col("system").alias("url"), "version", "code").agg(F.min("display").alias("display"))
    return at.join(d, ["url", "version", "code"], "left").select("canonical", "code", "version", "display")
