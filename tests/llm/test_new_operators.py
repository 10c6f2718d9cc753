"""Hard negatives, manifests and toxicity against plain definitions; long texts
in secret scans and null ids in the sample of language ID."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from fieldtrust.llm import embeddings, langid, merkle, negatives, ogg, queries, secrets, toxicity, urls

# ---------------------------------------------------------------- hard negatives


def brute_negatives(rows, k=5, low=80):
    """rows: different (id, label, whole numbers)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in rows:
        if a[0] % 100:
            continue
        scored = [(-dot(a[2], r[2]), r[0], r) for r in rows if r is not a]
        for s, pid, _ in sorted((x for x in scored if x[2][1] == a[1]), key=lambda x: x[:2])[:k]:
            good = sorted((x[:2] for x in scored if x[2][1] != a[1] and low * -s <= 100 * -x[0] <= 100 * -s))[:k]
            out += [(a[0], pid, n + 1, x[1], -s, -x[0]) for n, x in enumerate(good)]
    return sorted(out)


def whole(v):
    return [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]


@pytest.mark.parametrize("shape", ["clusters", "copies", "opposed"])
def test_negatives_equal_brute_force(spark, shape, monkeypatch):
    for name, value in (("SHARD", 60), ("ANCHORS", 2), ("GROUP", 3), ("_STEP", 2)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(5)
    if shape == "clusters":
        centers = rng.normal(size=(6, 12))
        made = [(10 * i, int(rng.integers(3)), (centers[i % 6] + 0.3 * rng.normal(size=12)).tolist()) for i in range(200)]
    elif shape == "copies":  # a third of all rows is one vector, in two labels
        base = rng.normal(size=8)
        made = [(10 * i, int(i % 2), (base if i % 3 == 0 else rng.normal(size=8)).tolist()) for i in range(150)]
    else:  # scores below zero and ties of whole numbers
        made = [(50 * i, int(i % 4), (rng.integers(-2, 3, size=4) / 256).tolist()) for i in range(120)]
    df = spark.createDataFrame([(i, v, lab, "x") for i, lab, v in made], "vec_id long, embedding array<float>, label int, anchor_id string")
    got = sorted(tuple(r) for r in negatives.mine(df).collect())
    assert got == brute_negatives([(i, lab, whole(v)) for i, lab, v in made]) and got


def test_negatives_edge_cases(spark):
    kind = "vec_id long, embedding array<float>, label int"
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [1.0, 0.25], 2), (3, [1.0], 2), (None, [1.0, 0.5], 2), (4, None, 2), (5, [1.0, None], 2), (6, [float("nan"), 1.0], 2),
        (7, [1.0, 0.5], None), (8, [], 2), (100, [0.5, 0.5], 3), (0, [0.0, 1.0], 1),
    ]
    used = [(0, 1, [256, 128]), (1, 1, [256, 64]), (2, 2, [256, 64]), (3, 2, [256]), (8, 2, []), (100, 3, [128, 128]), (0, 1, [0, 256])]
    got = sorted(tuple(r) for r in negatives.mine(spark.createDataFrame(rows, kind)).collect())
    assert got == brute_negatives(used)
    assert negatives.mine(spark.createDataFrame([], kind)).collect() == []
    assert negatives.mine(spark.createDataFrame(rows[2:4], kind)).collect() == []
    big = [(0, [1e12, 1.0], 1), (1, [1e12, 3.0], 1), (2, [1e12, 2.0], 2), (3, [9e11, 2.0], 2)]
    found = [tuple(r) for r in negatives.mine(spark.createDataFrame(big, "vec_id long, embedding array<double>, label int")).orderBy("rank").collect()]
    assert [r[:4] for r in found] == [(0, 1, 1, 2), (0, 1, 2, 3)] and {r[4] for r in found} == {2**63 - 1}  # sums of whole numbers, shown as the nearest long


# ---------------------------------------------------------------- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(digests, fanout):
    """Root, and for each digest the (left, right) siblings from below."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, p in enumerate(at):
            first = p // fanout * fanout
            run = digests[first : first + fanout]
            paths[i].append(("".join(run[: p - first]), "".join(run[p - first + 1 :])))
            at[i] = p // fanout
        digests = [h(*digests[i : i + fanout]) for i in range(0, len(digests), fanout)]
    return digests[0], paths


def plain_manifest(rows, fanout=16):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = plain_tree([plain_leaf(r) for r in by[s]], fanout)
    root, above = plain_tree([trees[s][0] for s in names], fanout)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for s, up in zip(names, above, strict=True):
        for r, path in zip(by[s], trees[s][1], strict=True):
            now = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                now = (*r[:4], r[4] and r[4].translate(lower))
            folded = plain_leaf(now)
            for left, right in path + up:
                folded = h(left, folded, right)
            out.append((r[0], plain_leaf(r), trees[s][0], root, h(*(a + b for a, b in path + up)), folded, folded == root))
    return sorted(out, key=str)


def test_manifest_equals_plain_trees(spark):
    rng = random.Random(4)
    rows = [(i, f"s{min(rng.randrange(40), 3)}", rng.choice([None, "en"]), i * 3, f"Text {i} É") for i in range(600)]
    rows += [(1000, "alone", "en", 1, "One LEAF"), (1001, None, None, None, None), (None, None, "en", 2, "ABC"), (1002, "", "de", 5, ""), (5, "s1", "en", 1, "Same id"), (5, "s1", "en", 1, "Same id")]
    rows += [(2000 + i, f"many{i:03}", "en", 1, "A" * i) for i in range(40)]  # more sources than one run
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string")
    got = sorted((tuple(r) for r in merkle.verify_digest(df).collect()), key=str)
    assert got == plain_manifest(rows)
    again = sorted((tuple(r) for r in merkle.verify_digest(df.repartition(7)).collect()), key=str)
    assert again == got and 0 < sum(not r[-1] for r in got) < len(got) / 2
    assert merkle.verify_digest(df.where("doc_id < 0")).collect() == []
    one = merkle.verify_digest(df.where("doc_id = 1000")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == h("")


def test_manifest_of_other_columns(spark):
    rows = [(f"k{i}", "a" if i < 20 else "b", i / 2) for i in range(30)]
    df = spark.createDataFrame(rows, "name string, part string, value double")
    got = merkle.build(df, "name", "part", ("name", "value"), fanout=3).orderBy("part", "position").collect()
    expected = sorted(rows)
    for part in "ab":
        mine = [plain_leaf((r[0], r[2])) for r in expected if r[1] == part]
        assert [r.leaf for r in got if r.part == part] == mine and {r.subroot for r in got if r.part == part} == {plain_tree(mine, 3)[0]}
    assert {r.root for r in got} == {h(*dict.fromkeys(r.subroot for r in got))}


# ---------------------------------------------------------------- toxicity


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op13_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in queries.table(spark, sf, "labels").collect()}
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, sf, "documents").collect()}
    assert got.keys() == texts.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [(got[i].score, t) for i, t in labels.items() if got[i].held_out]
    bad, good = sorted(s for s, t in held if t), sorted(s for s, t in held if not t)
    wins = sum(np.searchsorted(good, s) + (np.searchsorted(good, s, "right") - np.searchsorted(good, s)) / 2 for s in bad)
    assert wins / len(bad) / len(good) > 0.9
    assert sum(s >= 0.7 for s in good) / len(good) < 0.02  # clean documents are left alone
    words = {"idiot", "moron", "stupid", "scum"}
    insulted = [i for i, t in texts.items() if got[i].held_out and len(words & set(t.lower().split())) >= 2]
    assert len(insulted) > 20 and sum(got[i].predicted for i in insulted) / len(insulted) > 0.95
    # equal texts, equal scores
    by = defaultdict(set)
    for i, t in texts.items():
        by[t].add(got[i].score)
    assert all(len(s) == 1 for s in by.values())


def test_toxicity_edge_cases(spark):
    rng = random.Random(6)
    filler = lambda: " ".join("".join(rng.choices("abcdefgh", k=2)) for _ in range(12))
    clean = [(i, f"{filler()} the green house {filler()}", "x") for i in range(300)]
    toxic = [(1000 + i, f"{filler()} awful zork {filler()}", "y") for i in range(60)]
    docs = spark.createDataFrame([*clean, *toxic, (None, None, "z"), (5000, "", "z"), (5001, "word " * 50_000 + "awful zork", "z"), (5002, "Die grüne Straße 你好", "z"), (None, "awful zork", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1000 + i, 1, 0) for i in range(60)] + [(i, 0, 1) for i in range(100)] + [(1000, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert docs.columns + ["score_", "predicted"] == toxicity.score(docs, model).columns and len(rows) == 365
    found = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(found[i].predicted == (i >= 1000) for i in found if i < 2000) and found[5001].predicted == 1 and found[5002].predicted == found[5000].predicted == 0
    assert {r.predicted for r in rows if r.doc_id is None} == {0, 1}
    shuffled = toxicity.train(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(shuffled.features, model.features) and np.allclose(shuffled.weights, model.weights)
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r.score_ for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.where("doc_id < 0"), model).collect() == [] and toxicity.train(docs.where("doc_id < 0"), labels).prior == 0.0


def test_risk_is_not_negative():
    """The fit on a sample where unlabelled positives are many still tells the classes apart."""
    rng = np.random.default_rng(8)
    positive, rows, hashes = [], [], []
    for n in range(900):
        is_positive = n < 200
        toxic = is_positive or rng.random() < 0.3
        features = set(rng.integers(100, 160, 5)) | ({int(rng.integers(1, 6))} if toxic else set())
        positive.append(is_positive)
        rows += [n] * len(features)
        hashes += [int(f) for f in features]
    model = toxicity.fit(np.array(positive), np.array(rows), np.array(hashes, np.uint64), 0.3)
    assert set(model.features.tolist()) == {1, 2, 3, 4, 5} and model.weights.min() > 2 and model.bias < 0
    assert model.chances(pa.array(["", None]))[0] < 0.2
    prior = toxicity.estimated_prior(np.array(positive), np.array(rows), np.array(hashes, np.uint64), 0.05)
    assert 0.2 < prior < 0.45


# ---------------------------------------------------------------- long texts, null ids


@pytest.mark.parametrize("part", ["ab/", "a-", "A_", "ab1", "x=", "token=abcd1234 ", "AKIAABCDEFGH1234", "0f", "/a", "a", "-"])
def test_secrets_in_a_megabyte(spark, part):
    text = part * (1_000_000 // len(part))
    row = secrets.scan_digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_assign, row.n_access, row.n_hex) == {"token=abcd1234 ": (len(text) // len(part), 0, 0), "AKIAABCDEFGH1234": (0, 1, 0), "0f": (0, 0, 1), "a": (0, 0, 1), "ab1": (0, 0, 1)}.get(part, (0, 0, 0))
    assert row.spans.count("entropy") == 0 or part == "AKIAABCDEFGH1234"


def test_language_sample_with_null_ids(spark):
    words = {"en": "the and house green water".split(), "de": "und das haus wasser straße".split()}
    rng = random.Random(2)
    rows = [(lang, " ".join(rng.choices(words[lang], k=8)) + f" {lang}x{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}") for lang in words for i in range(400)]
    schema = "doc_id long, text string, lang string"
    models = []
    same = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 4 != 2)
    for ids in ((lambda n: None), (lambda n: same)):
        one = spark.createDataFrame([(ids(n), t, lang) for n, (lang, t) in enumerate(rows)], schema)
        other = spark.createDataFrame([(ids(n), t, lang) for n, (lang, t) in enumerate(reversed(rows))], schema).repartition(3)
        a, b = langid.train(one, 60), langid.train(other, 60)
        assert a.labels == b.labels == ["de", "en"] and np.array_equal(a.keys, b.keys) and np.allclose(a.weights, b.weights)
        models.append(a)
    test = spark.createDataFrame([(1, "das haus und wasser"), (2, "the green house and water")], "doc_id long, text string")
    for model in models:
        assert [r.lang_pred for r in langid.predict(test, model).orderBy("doc_id").collect()] == ["de", "en"]


@pytest.mark.parametrize("name", ["op11_negatives", "op12_merkle"])
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in got.select(names).collect()))) == sorted(map(str, found.fetchall()))


# ---------------------------------------------------------------- damaged media, tiny vectors, large rule sets


def test_damaged_media(spark):
    whole = ogg.store(b"abc" * 500)
    pages = [whole.index(b"OggS", i) for i in range(len(whole)) if whole.startswith(b"OggS", i)]
    cases = {0: whole, 1: None, 2: b"", 3: b"no container", 4: whole[: len(whole) // 2], 5: whole[: pages[0] + 30] + b"x" + whole[pages[0] + 31 :], 6: whole[: pages[1] + 30] + b"x" + whole[pages[1] + 31 :], 7: whole[: pages[-1]]}
    cases |= {100 + i: whole[:p] + whole[p + 40 :] for i, p in enumerate(pages)}
    df = spark.createDataFrame(list(cases.items()), "doc_id long, media binary")
    got = {r.doc_id: r for r in ogg.from_media(df).collect()}
    assert len(got) == len(cases) and bytes(got[0].payload).startswith(b"abc" * 500) and got[0].n_bytes == 1500
    assert tuple(got[1])[1:] == (None, None, None) and all(got[i].payload is None for i in (2, 3))
    assert all(r.n_bytes in (1500, None) for r in got.values()) and any(r.payload is None for i, r in got.items() if i > 3)


def test_tiny_and_huge_vectors_link(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, ((base + 0.01 * rng.normal(size=16)) * scale).tolist()) for i, scale in enumerate((1.0, 1e-200, 1e-300, 1e200, 1e150))] + [(9, rng.normal(size=16).tolist())]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**{i: (4, 0) for i in range(5)}, 9: (0, 9)}


@pytest.mark.parametrize("max_bytes", [200, 5000])
def test_rules_in_many_arrays(spark, max_bytes):
    rules = spark.createDataFrame([(f"h{i}.com", "/" if i % 2 else "/a/", "block" if i % 3 else "allow") for i in range(60)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://{'www.' if i % 4 else ''}h{i % 80}.com/a/{i}") for i in range(400)], "page_id long, url string")
    one = sorted(map(tuple, urls.judge(pages, rules).collect()))
    assert sorted(map(tuple, urls.judge(pages, rules, max_bytes=max_bytes).collect())) == one and any(r[3] for r in one)
