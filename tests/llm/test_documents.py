import hashlib
import os
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import common, components, fingerprints, license_scan, near_duplicates, vector_topk, warc_fixity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def words(n, seed, vocabulary=5000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def corpus():
    rows, k = [], 0
    for g in range(12):
        base = words(150, g).split()
        for c in range(1 + g % 6):
            x = list(base)
            for _ in range(c):
                x[random.Random(g * 100 + c).randrange(150)] = f"new{g}{c}"
            rows.append((k, " ".join(x)))
            k += 1
    shared = words(100, 777)
    rows += [(k + i, shared + " " + words(60, 1000 + i)) for i in range(90)]  # share a long passage, are not near
    k += 90
    return rows + [(k, None), (k + 1, ""), (k + 2, "Two words"), (k + 3, "two  WORDS!"), (k + 3, "two words"), (None, "two words"), (None, "alone without an id"), (k + 4, "a b c d e " * 4000), (k + 5, "a b c d e " * 4001)]


def brute(rows):
    bags = [near_duplicates.bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = not len(bags[i][0]) and not len(bags[j][0]) and (rows[i][1] or "") == (rows[j][1] or "")
            if same or near_duplicates.overlap(bags[i], bags[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(tuple([sorted([x for x in g if x is not None]), sum(x is None for x in g)]) for g in groups.values())


def test_near_duplicates_equal_all_pairs(spark):
    rows = corpus()
    out = near_duplicates.near_duplicate_classes(docs(spark, rows)).collect()
    groups = {}
    for r in out:
        groups.setdefault((r["class_id"], r["h1"] if r["class_id"] is None else 0), []).append(r["doc_id"])
    assert len(out) == len(rows)
    assert sorted(tuple([sorted([x for x in g if x is not None]), sum(x is None for x in g)]) for g in groups.values()) == brute(rows)
    assert all(r["class_id"] is None or r["class_id"] <= (r["doc_id"] if r["doc_id"] is not None else r["class_id"]) for r in out)
    assert near_duplicates.near_duplicate_classes(docs(spark, [])).count() == 0


def one_shared_band():
    """Texts of one bucket, all unlike but the last two: these share no other band, and are neither its first nor the member with the least of its own."""

    def changed(at, n, seed):
        return [*x[:at], *words(n, seed, 10**9).split(), *x[at + n :]]

    def keys(texts):
        return near_duplicates.bands(near_duplicates.signatures([near_duplicates.bag(" ".join(t)) for t in texts]))

    x = words(150, 1, 10**9).split()
    mine = keys([x])[0]
    near = [changed(50, 12, s) for s in range(2, 2500)]  # 130 of 162 shingles
    same = keys(near) == mine
    for k in np.flatnonzero(same.sum(1) == 1):
        band = int(same[k].argmax())
        inner = [x[a : a + 120] for a in range(31)]  # wholly of x's shingles
        others = [changed(100 - s % 90, 17, 10_000 + s) for s in range(120)]
        inner = [t for t, b in zip(inner, keys(inner), strict=True) if b[band] == mine[band]]
        others = [t for t, b in zip(others, keys(others), strict=True) if b[band] == mine[band]]
        if inner and len(others) > 3:
            return [" ".join(t) for t in (*others[:4], inner[0], x, near[k])]


def test_a_pair_of_one_shared_band_is_found(spark):
    rows = list(enumerate(one_shared_band()))
    out = near_duplicates.near_duplicate_classes(docs(spark, rows)).collect()
    assert brute(rows) == sorted([([k], 0) for k in range(5)] + [([5, 6], 0)])
    assert {r["doc_id"]: r["class_id"] for r in out} == {**{k: k for k in range(6)}, 6: 5}


def test_recall_on_a_whole_table(spark):
    """Links of the 1000-document table by brute force over an inverted index of its shingles: the share that ends in one class."""
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    bags = {d: near_duplicates.bag(t) for d, t in rows}
    index = {}
    for d, (h, _) in bags.items():
        for x in h.tolist():
            index.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in index.values() if len(ds) < 400 for a in ds for b in ds if a < b}
    assert all(len(ds) < 400 for ds in index.values())
    links = [(a, b) for a, b in pairs if near_duplicates.overlap(bags[a], bags[b]) >= 0.8]
    classes = {r["doc_id"]: r["class_id"] for r in near_duplicates.op2_near_duplicates(spark, SF).collect()}
    assert len(links) > 50 and np.mean([classes[a] == classes[b] for a, b in links]) >= 0.99
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    together = [(a, b) for a in classes for b in [classes[a]] if a != b]
    assert all(find(a) == find(b) or bags[a][0].size == bags[b][0].size == 0 for a, b in together)


def wide(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars int")


def test_rows_without_an_id_are_near_duplicates_too(spark):
    base, other, third = words(150, 1), words(150, 2), words(150, 3)
    rows = [(7, base), (None, base + " more"), (None, base.upper()), (None, other), (None, other + " more"), (None, other), (9, third), (8, third + " more")]
    out = near_duplicates.near_duplicate_classes(docs(spark, rows)).collect()
    assert len(out) == len(rows) and len({r["h1"] for r in out}) == 3
    assert sorted((r["doc_id"], r["class_id"]) for r in out if r["doc_id"]) == [(7, 7), (8, 8), (9, 8)]
    assert sorted(str(r["class_id"]) for r in out if r["doc_id"] is None) == ["7", "7", "None", "None", "None"]
    for lone in (rows, [r for r in rows if r[1][:9] != other[:9]]):
        kept = corpus_pipeline.near_duplicate(spark, wide(spark, lone), SF)
        assert kept.columns == corpus_pipeline.COLUMNS
        kept = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert {x for x in kept if x[0]} == {(7, base), (8, third + " more")}
        assert [t[:9] for d, t in kept if d is None] == ([other[:9]] if lone is rows else [])
    apart = corpus_pipeline.near_duplicate(spark, wide(spark, [(None, base), (None, base + " more"), (None, third)]), SF)
    assert apart.count() == 2


def test_an_id_on_different_texts(spark):
    base, other = words(150, 1), words(150, 2)
    rows = [(1, base), (1, other), (2, base + " more"), (3, other + " more"), (1, base)]
    out = near_duplicates.near_duplicate_classes(docs(spark, rows)).collect()
    assert [r["class_id"] for r in out] == [1] * 5
    h = {d: {r["h1"] for r in out if r["doc_id"] == d} for d in (1, 2, 3)}
    assert h[2] | h[3] == h[1] and len(h[1]) == 2
    kept = corpus_pipeline.near_duplicate(spark, wide(spark, rows), SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, base), (1, other)])


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    off = []
    for _ in range(60):
        h = np.sort(rng.integers(0, 2**63, 60).astype("uint64"))
        a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
        b = np.where(rng.random(60) < 0.7, a, b)
        x, y = (h[a > 0], a[a > 0]), (h[b > 0], b[b > 0])
        s = near_duplicates.signatures([x, y])
        off.append((s[0] == s[1]).mean() - near_duplicates.overlap(x, y))
    assert abs(np.mean(off)) < 0.012 and np.sqrt(np.mean(np.square(off))) < 0.035


def test_components(spark):
    random.seed(2)
    e = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (200, 199)] + [(300, 300 + random.randint(1, 60)) for _ in range(80)]
    out = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(41)) and out[102] == out[101] == out[100] == 100 and out[200] == 199
    assert all(v == 300 for k, v in out.items() if k >= 300)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edited_documents_equal_a_loop(spark):
    rows = [(i * 3 - 50, t) for i, (_, t) in enumerate(corpus())]
    order = sorted(rows, key=lambda r: -r[0])
    out = {r["doc_id"]: r for r in fingerprints.compare_edited(docs(spark, rows)).collect()}
    assert len(out) == len(rows)
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        r, f = out[d], fingerprints.simhash(t)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == f.hex() and r["edited_fingerprint"] == fingerprints.simhash(edited).hex()
        assert r["near_edited"] == fingerprints.likeness(f, fingerprints.simhash(edited)) and r["near_next"] == fingerprints.likeness(f, fingerprints.simhash(after))
    assert fingerprints.compare_edited(docs(spark, [])).count() == 0
    assert fingerprints.compare_edited(docs(spark, [(4, "one text alone")])).first()["near_next"] == 1.0
    assert fingerprints.compare_edited(docs(spark, [(1, "a b"), (1, "a b"), (None, None), (None, "x"), (5, "")])).count() == 5


def test_near_fingerprints_equal_all_pairs(spark):
    random.seed(4)
    base = [random.getrandbits(128) for _ in range(30)]
    fps = {f"{b ^ sum(1 << random.randrange(128) for _ in range(k)):032x}"[-32:] for b in base for k in range(6)}
    df = spark.createDataFrame([(x,) for x in fps] * 2 + [(None,)], "fingerprint string")
    got = {(r["a"], r["b"], r["distance"]) for r in fingerprints.near_fingerprints(df, 3, 6).collect()}
    want = {(a, b, (int(a, 16) ^ int(b, 16)).bit_count()) for a in fps for b in fps if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= 3}
    assert got == want and want


def duck(**tables):
    c = duckdb.connect()
    for name in "documents pages embeddings".split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("module, name", [(vector_topk, "op5_vector_topk"), (warc_fixity, "op6_warc_fixity"), (license_scan, "op8_license_scan")])
def test_sql(spark, module, name):
    got = module.QUERIES[name](spark, SF)
    cur = duck().execute(module.ORACLE[name])
    cols = [x[0] for x in cur.description]
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(cur.fetchall())


def test_top_k_cases(spark):
    v = vector_topk.whole_numbers
    from pyspark.sql import functions as F

    rows = [(0, [0.5, 0.5]), (50, [1.0, -1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", v(F.col("embedding")).alias("v"))
    got = sorted(tuple(r) for r in vector_topk.top_k(df.filter("vec_id % 50 = 0"), df).collect())
    assert got == [(0, 1, 1, 32768), (0, 2, 2, 32768), (0, 3, 2, 32768), (0, 4, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0), (50, 4, 2, 0)]
    assert vector_topk.top_k(df.limit(0), df).count() == 0


def by_hand(queries, vectors, k=5):
    out = []
    for i, (qid, q) in enumerate(queries):
        s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=True)))), vid) for j, (vid, v) in enumerate(vectors) if j != i and len(v) == len(q))
        out += [(qid, r + 1, vid, -x) for r, (x, vid) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [40, 300, 10**7, 2**61])
def test_top_k_equals_a_loop(spark, monkeypatch, scale):
    monkeypatch.setattr(vector_topk, "BLOCK_ROWS", 90)
    monkeypatch.setattr(vector_topk, "QUERY_ROWS", 11)
    monkeypatch.setattr(vector_topk, "FIRST_READ", 1)
    rng = np.random.default_rng(1)
    rows = [(k // 2 * 2 if k < 40 else k, rng.integers(-scale, scale, 16 if k % 5 else 3).tolist()) for k in range(400)]
    rows[50:120] = [(k, rows[50][1]) for k in range(50, 120)]  # many ties
    df = spark.createDataFrame([(k, i, v) for k, (i, v) in enumerate(rows)], "row long, vec_id long, v array<long>")
    got = vector_topk.top_k(df.filter("row < 60"), df).collect()
    assert sorted(tuple(r) for r in got) == by_hand(rows[:60], rows)


def test_top_k_takes_large_values_and_no_components(spark):
    from pyspark.sql import functions as F

    rows = [(0, [3e38, 1.0]), (50, [-3e38, 1.0]), (1, [3e38, 0.0]), (2, [1.0, 1.0]), (100, []), (3, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", vector_topk.whole_numbers(F.col("embedding")).alias("v"))
    got = sorted(tuple(r) for r in vector_topk.top_k(df.filter("vec_id % 50 = 0"), df).collect())
    big = 2**63 - 1
    assert [r for r in got if r[0] == 0][0] == (0, 1, 1, big) and (0, 3, 50, -(2**63)) in got and (100, 1, 3, 0) in got


def test_fixity_finds_what_was_changed(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://x/{k}", "page " * (k % 50)) for k in range(2500)] + [(7, "http://x/7", "again"), (None, None, None)], "page_id long, url string, html string")
    assert {(r["status"], r["level"]) for r in warc_fixity.audit(pages, pages).collect()} == {("same", warc_fixity.TOP)}
    from pyspark.sql import functions as F

    bad = pages.filter("page_id IS NULL OR page_id <> 1234").withColumn("html", F.when(F.col("page_id") == 99, "!").otherwise(F.col("html"))).unionByName(spark.createDataFrame([(9001, "u", "h")], pages.schema))
    out = warc_fixity.audit(pages, bad).filter("level = 0").collect()
    assert sorted((r["archive"], r["node"], r["status"]) for r in out) == [(0, 99, "differs"), (1, 234, "missing"), (9, 1, "extra")]
    assert warc_fixity.audit(pages.limit(0), pages.limit(0)).count() == 0
    path = str(tmp_path / "w")
    warc_fixity.write_warc(pages.filter("page_id < 40"), path)
    back = {r["record_id"]: r["body"].decode() for r in warc_fixity.read_warc(spark, path).collect()}
    assert len(back) == 40 and back["<urn:page:49>" if "<urn:page:49>" in back else "<urn:page:39>"] == "page " * 39


def test_fixity_of_any_ids_and_texts(spark):
    rows = [(-1, "a", "x"), (None, "a", "x"), (-(2**63), "b", None), (2**63 - 1, None, "y" * 300_000), (5, "c", "")]
    schema = "page_id long, url string, html string, hash int, archive int"
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], schema)
    for k in range(len(rows)):
        bad = spark.createDataFrame([(*(r[:2], r[:1] + ("changed",))[j == k], (r[2] or "") + "!" * (j == k), 1, 2) for j, r in enumerate(rows)], schema)
        out = warc_fixity.audit(pages, bad).collect()
        assert sorted(r["level"] for r in out) == list(range(warc_fixity.TOP + 1)) and {r["status"] for r in out} == {"differs"}
    leaf = warc_fixity.leaves(pages).collect()
    assert len({(r["archive"], r["slot"]) for r in leaf}) == len(rows)
    assert {r["status"] for r in warc_fixity.audit(pages, pages.limit(0)).collect()} == {"missing"}


def test_reading_warc_files(spark, tmp_path):
    import gzip

    head = b"WARC/1.0\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %s\r\n\r\n%s\r\n\r\n"
    parts = [head % (1, b"3", b"abc"), head % (2, b"many", b"no length"), head % (3, b"-4", b"x"), head % (4, b"5", b"\r\n\r\n!"), head % (5, b"999", b"cut")]
    (tmp_path / "a.warc").write_bytes(b"noise" + b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)) + gzip.compress(parts[0])[:-9])
    (tmp_path / "c.warc").write_bytes(b"")
    out = warc_fixity.read_warc(spark, str(tmp_path)).collect()
    plain = {r["record_id"]: bytes(r["body"]) for r in out if r["file"].endswith("a.warc")}
    assert plain == {"<urn:page:1>": b"abc", "<urn:page:2>": b"no length\r\n\r\n", "<urn:page:3>": b"x\r\n\r\n", "<urn:page:4>": b"\r\n\r\n!", "<urn:page:5>": b"cut\r\n\r\n"}
    packed = [(r["offset"], r["record_id"], bytes(r["body"])) for r in out if r["file"].endswith(".gz")]
    at = [0, *np.cumsum([len(gzip.compress(p)) for p in parts]).tolist()]
    assert sorted(packed)[:5] == [(a, f"<urn:page:{k + 1}>", plain[f"<urn:page:{k + 1}>"]) for k, a in enumerate(at[:5])]
    pages = spark.createDataFrame([(k, f"u{k}", f"page {k}") for k in range(60)], "page_id long, url string, html string")
    warc_fixity.write_warc(pages, str(tmp_path / "one"))
    warc_fixity.write_warc(pages.filter("page_id <> 33"), str(tmp_path / "two"))
    found = warc_fixity.audit_files(spark, str(tmp_path / "one"), str(tmp_path / "two")).filter("level = 0").collect()
    assert [(r["archive"], r["node"], r["status"]) for r in found] == [(0, 33, "missing")]


def test_license_cases(spark):
    t = license_scan.standard_templates(spark)
    rows = [(1, None), (2, ""), (3, "ALL rights\n\nreserved"), (4, "x " * 3000 + "released under the MIT license " + "y " * 3000), (4, "nothing"), (5, "released under the license"), (None, "Licensed under CC BY-NC 4.0")]
    out = {(r["doc_id"], r["template_id"]) for r in license_scan.scan(docs(spark, rows), t).collect()}
    assert out == {(3, "all-rights-reserved"), (4, "mit-line"), (None, "cc-by-nc-4.0-line")}
    assert license_scan.scan(docs(spark, []), t).count() == 0
    text = next(b for a, b in license_scan.TEMPLATES if a == "gpl-notice").replace("General Public", "Special Public")
    partly = license_scan.scan(docs(spark, [(1, "intro " * 9 + text)]), t, least=0.7).filter("template_id = 'gpl-notice'").first()
    assert partly is not None and 0.7 <= partly["containment"] < 1


def test_language_stage_rejects_what_was_never_learned(spark):
    r = random.Random(1)
    noise = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(90))
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem"
    clean = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 200").orderBy("doc_id").first()["text"]
    kept = corpus_pipeline.language(spark, wide(spark, [(1, noise), (2, polish), (3, clean)]), SF)
    assert [x["doc_id"] for x in kept.collect()] == [3]


def test_pipeline_stages(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(900001, None, None, None, None), (900002, "", "en", "s", 0), (900003, "123 456", "en", "s", 7)], table.schema)
    now = table.unionByName(extra)
    one = common.durable(corpus_pipeline.language(spark, now, SF), "t1")
    assert one.columns == table.columns
    gone = {r[0] for r in now.join(one, "doc_id", "left_anti").select("doc_id").collect()}
    assert {900001, 900002, 900003} <= gone and len(gone) <= 8
    two = common.durable(corpus_pipeline.toxic(spark, one, SF), "t2")
    assert two.columns == table.columns and 0.8 * one.count() < two.count() < one.count()
    three = common.durable(corpus_pipeline.near_duplicate(spark, two, SF), "t3")
    rows = [(r["doc_id"], r["text"]) for r in two.collect()]
    kept = {r[0] for r in three.select("doc_id").collect()}
    classes = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicate_classes(two).collect()}
    assert three.columns == table.columns and kept == set(classes.values()) and len(rows) > len(kept)
    four = corpus_pipeline.pack(spark, three, SF)
    assert {r[0] for r in four.select("doc_id").distinct().collect()} == kept
