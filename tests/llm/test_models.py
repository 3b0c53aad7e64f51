import itertools
import os

import numpy as np

from tessera.llm import language_id as li
from tessera.llm import toxicity as tx

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def small_model(spark):
    return li.fit(docs(spark, [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("кошка и собака", "ru")] * 5)] + [(99, None, "en"), (100, "x", None)]))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    lab = li.Labeller(li.Model({}, {}, {}), 2.0)
    scores = [rng.uniform(-3, 0, (n, 3)) for n in (1, 2, 5, 6, 7)]

    def value(s, p):
        return sum(s[k, p[k]] for k in range(len(p))) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))

    for s, path in zip(scores, lab.viterbi(scores), strict=True):
        best = max(value(s, p) for p in itertools.product(range(3), repeat=len(s)))
        assert abs(value(s, list(path)) - best) < 1e-9
        if (c := lab.constant(s)) is not None:
            assert abs(value(s, list(c)) - best) < 1e-9


def test_labels_equal_exhaustive_search():
    rng = np.random.default_rng(5)
    short = 0
    for k in range(10_000):
        n, langs, penalty = int(rng.integers(1, 7)), int(rng.integers(2, 5)), float(rng.uniform(0.2, 8))
        s = rng.uniform(-4, 0, (n, langs))
        if k % 3 == 0:  # stretches of one language each, with others close behind
            s = np.repeat(s[: (n + 1) // 2], 2, axis=0)[:n]
        s -= s.max(1, keepdims=True)
        paths = np.array(list(itertools.product(range(langs), repeat=n)))
        value = s[np.arange(n), paths].sum(1) - penalty * (np.diff(paths, axis=1) != 0).sum(1)
        lab = li.Labeller(li.Model({}, {}, {}), penalty)
        path = lab.constant(s)
        short += path is not None
        path = lab.viterbi([s])[0] if path is None else path
        got = s[np.arange(n), path].sum() - penalty * (np.diff(path) != 0).sum()
        assert abs(got - value.max()) < 1e-6
    assert 500 < short < 9_500  # both ways were taken


def test_no_column_of_the_caller_is_lost(spark):
    from pyspark.sql import functions as F

    base = docs(spark, [(1, "the dog", "x")]).withColumns({c: F.lit(1) for c in ("_found", "fit", "score", "spans", "lang_pred")})
    row = li.with_language(base, small_model(spark), spans=True).first()
    assert (row["_found"], row["lang"], row["lang_pred"]) == (1, "x", "en") and row["score"] > 0 and len(row["spans"]) == 1
    row = tx.with_toxicity(base, tx.prior_model()).first()
    assert row["_found"] == 1 and row["predicted"] == 0


def test_two_languages_with_a_third_between():
    lab = li.Labeller(li.Model({}, {}, {}), 12.0)
    s = np.array([[0.0, -6, -2]] * 5 + [[-6.0, 0, -2]] * 5)
    assert lab.constant(s) is None and list(lab.viterbi([s])[0]) == [0] * 5 + [1] * 5
    assert list(lab.constant(s[:5])) == [0] * 5


def test_language_cases(spark):
    m = small_model(spark)
    rows = [(1, None, ""), (2, "", ""), (3, "12 ½ !", ""), (4, "the dog", ""), (5, "собака", ""), (6, "中文", ""), (7, "the dog and the cat " * 8 + "die katze und der hund " * 8, ""), (7, "the dog", ""), (8, "the dog " * 30000, "")]
    out = li.with_language(docs(spark, rows), m, spans=True).collect()
    got = {(r["doc_id"], (r["text"] or "")[:3]): (r["lang_pred"], r["score"]) for r in out}
    assert len(out) == len(rows)
    assert got[1, ""] == got[2, ""] == got[3, "12 "] == ("und", 0.0)
    assert got[4, "the"][0] == got[8, "the"][0] == "en" and got[5, "соб"] == ("ru", 1.0)
    assert got[6, "中文"][1] == 0.0 and got[6, "中文"][0] in m.langs
    spans = next(r["spans"] for r in out if len(r["text"] or "") > 300 and r["doc_id"] == 7)
    assert [s["lang"] for s in spans] == ["en", "de"]
    assert li.with_language(docs(spark, []), m).count() == 0
    nothing = li.fit(docs(spark, []))
    assert [r["lang_pred"] for r in li.with_language(docs(spark, [(1, "abc", None)]), nothing).collect()] == ["und"]


def test_language_held_out_accuracy(spark):
    out = li.op7_language_id(spark, SF).filter("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97


def test_grammar_marks():
    g = tx.Grammar(tx.prior_model())
    marks = lambda t: [sorted(m[2]) for m in g.matches(t)]
    assert marks("You are an idiot.") == [["directed", "insult"]]
    assert marks("The idiot left") == [["insult"]]
    assert marks("He is not stupid") == [["directed", "insult", "negated"]]
    assert marks("She said the man was a moron") == [["directed", "insult", "reported"]] or marks("She said the man was a moron") == [["insult", "reported"]]
    assert marks("I will kill you") == [["directed", "threat"]]
    assert marks("killing time, skill") == []
    assert marks("Not now. Idiot!") == [["insult"]]  # a clause's negation ends with it
    assert g.score("You are an idiot") > g.score("You are not an idiot") > g.score("fine words")
    assert g.score("I will kill you") > g.score("The frost may kill plants")
    assert 0 <= g.score(None) == g.score("") <= 1


def test_composition_runs_all_machines_at_once():
    both = tx.emitter("I", "insult").compose(tx.within("N", 2, "negated")).compiled()
    assert [sorted(x) for x in both.run("NOIOI")] == [[], [], ["insult", "negated"], [], ["insult"]]


def test_composed_machine_equals_the_five_run_apart():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        string = "".join(rng.choice(list("OITVNR"), int(rng.integers(0, 14)), p=[0.4, 0.2, 0.15, 0.1, 0.08, 0.07]))
        apart = [frozenset().union(*marks) for marks in zip(*(m.run(string) for m in tx.PARTS), strict=True)]
        assert tx.MACHINE.run(string) == apart
        hits = [k for k, c in enumerate(string) if c in "IV"]
        back = lambda k, c, n: c in string[max(0, k - n) : k]
        want = {"I": "insult", "V": "threat"}
        marks = {want[string[k]] for k in hits}
        marks |= {"directed"} if any(back(k, "T", 4) or "T" in string[k + 1 : k + 4] for k in hits) else set()
        marks |= {f for f, c, n in (("negated", "N", 3), ("reported", "R", 8)) if hits and all(back(k, c, n) for k in hits)}
        seen = tx.clause_marks(string)
        # a later match or target restarts the machine's count, so a target is never missed
        assert seen == marks


def test_a_clause_counts_once_whatever_its_length():
    g = tx.Grammar(tx.prior_model())
    assert g.score("idiot idiot idiot") == g.score("idiot") < g.score("idiot, idiot, idiot")
    far = "word " * 3000
    assert [(m[0], sorted(m[2])) for m in g.matches(far + "you are an idiot " + far)] == [("idiot", ["directed", "insult"])]
    assert next(g.matches(far + "you are an idiot " + far))[3:] == (0, len(far) * 2 + 17)
    assert sorted(next(g.matches("Ich werde dich umbringen"))[2]) == ["directed", "threat"]


def test_copies_and_repeated_ids_add_nothing(spark):
    copies = [(1, "alpha vileword beta. gamma delta", 1)] * 30 + [(k, f"clean{k} words only", 0) for k in range(2, 40)]
    rows = spark.createDataFrame(copies, "doc_id long, text string, toxic int")
    assert set(tx.fit(rows.select("text", "toxic")).stems) == set(tx.INSULTS)
    labels = rows.select("doc_id", "toxic")
    assert tx.sample(rows.select("doc_id", "text"), labels).count() == 39
    name = lambda k: "".join("abcdefghij"[int(d)] for d in str(k))  # noqa: E731  (a clause is its words' letters)
    apart = [(k, f"left{name(k)} vileword right{name(k)}. gamma", 1) for k in range(30)] + [(k, f"clean{name(k)} words only", 0) for k in range(30, 90)]
    assert "vileword" in tx.fit(spark.createDataFrame(apart, "doc_id long, text string, toxic int").select("text", "toxic")).stems


def test_toxicity_rows(spark):
    rows = [(1, None, ""), (2, "", ""), (3, "you idiot " * 5000, ""), (3, "you idiot", ""), (4, "word " * 50000, "")]
    out = tx.with_toxicity(docs(spark, rows), tx.prior_model()).collect()
    assert sorted((r["doc_id"], r["predicted"]) for r in out) == [(1, 0), (2, 0), (3, 1), (3, 1), (4, 0)]
    assert tx.with_toxicity(docs(spark, []), tx.prior_model()).count() == 0
    nothing = spark.createDataFrame([], "text string, toxic int")
    assert tx.fit(nothing).weights == tx.PRIOR


def test_stems_are_learned_once_for_copies():
    # 40 toxic copies share many words; only one stem that also explains others is needed
    tox = [(1, [0, 1, 2])] * 40 + [(1, [0])] * 30
    names = {"insu": (70, 0, 5.0), "copya": (40, 0, 4.0), "copyb": (40, 0, 4.0)}
    assert list(tx.choose(names, tox + [(0, [])] * 50))[0] == "insu"


def test_toxicity_held_out(spark):
    out = tx.op1_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    r = out.filter("held_out").join(labels, "doc_id").collect()
    a = [x["score"] for x in r if x["toxic"] == 1]
    b = [x["score"] for x in r if x["toxic"] == 0]
    assert np.mean([(x > y) + 0.5 * (x == y) for x in a for y in b]) > 0.75
    assert np.mean([x >= 0.5 for x in a]) >= 0.8
    assert np.mean([x["predicted"] for x in r if x["toxic"] == 0]) < 0.02


def test_hits_are_evaluated_once(spark):
    """A filter on the hits adds no second Python node, whose workers would stay beside the first's in every executor."""
    clauses = spark.createDataFrame([("du bist ein dummkopf", 1), ("good day", 1), (None, 1)], "clause string, toxic int")
    out = tx.clauses_hit(clauses, ["dummkopf", "dumm", "foo"])
    assert [tuple(r) for r in out.collect()] == [(1, [0, 1])]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
