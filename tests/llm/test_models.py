"""Classifiers by held-out accuracy on the given tables, personal data by brute force, joins by brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from calspark.llm import embedding_dedup, linear, ngram_join, pii, quality, toxicity
from calspark.llm.components import components

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def odd(spark):
    return spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "word " * 30000, "x"), (3, "word " * 30000, "x"), (4, "\n \t", "x"), (5, "ééé ñ 漢字", "x")], "doc_id long, text string, score string")


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    found = quality.quality(docs, labels).join(labels, "doc_id").filter("held_out")
    n, right = found.agg(F.count(F.lit(1)), F.sum((F.col("quality") == F.col("predicted")).cast("int"))).first()
    assert n > 80 and right / n > 0.95
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_quality_without_usable_labels(spark, tables):
    rows = quality.quality(odd(spark), tables[1].limit(0)).collect()
    assert len(rows) == 7 and {r["score"] for r in rows} == {0.5}
    assert quality.quality(odd(spark).limit(0), tables[1]).collect() == []


def test_quality_catches_bad_texts(spark, tables):
    docs, labels = tables
    found = quality.quality(docs, labels).join(labels, "doc_id").filter("held_out AND quality = 0")
    n, caught = found.agg(F.count(F.lit(1)), F.sum(1 - F.col("predicted"))).first()
    assert n > 10 and caught / n > 0.85


def test_quality_features_equal_brute_force():
    texts = ["A b A b", "", "x, x", "Über uns über"]
    doc, feature = quality.features(texts)
    for i, t in enumerate(texts):
        alone = set(quality.features([t])[1].tolist())
        assert set(feature[doc == i].tolist()) == alone
        words = re.findall(r"[^\W\d_]+|[0-9]|[^\s\w]+", t)
        grams = {tuple(words[k: k + n]) for n in (1, 2) for k in range(len(words) - n + 1)}
        assert sum(f >= quality.DIMENSIONS for f in alone) == len(grams)
    assert len(doc) == len(set(zip(doc.tolist(), feature.tolist())))


def test_quality_of_odd_rows(spark, tables):
    docs = odd(spark).drop("score").withColumn("score", F.lit("clash"))
    model = quality.fit(tables[0], tables[1], ~quality.held_out())
    rows = quality.score(docs.fillna("", ["text"]), model, "s").collect()
    assert len(rows) == 7 and all(0 <= r["s"] <= 1 for r in rows)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out")
    count = {(r["toxic"], r["predicted"]): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    toxic, clean = count[1, 1] + count.get((1, 0), 0), count[0, 0] + count.get((0, 1), 0)
    print("recall", count[1, 1], toxic, "clean flagged", count.get((0, 1), 0), clean)
    assert toxic > 60 and count[1, 1] / toxic >= 0.8
    assert clean > 400 and count.get((0, 1), 0) / clean <= 0.02


def test_toxicity_of_odd_rows(spark, tables):
    rows = toxicity.toxicity(odd(spark), tables[1]).collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows)


def gapped(a, b):
    """The kernel of two words by brute force: hashed triples of letters, three to six places wide, scaled to length one."""
    def counts(word):
        padded = [toxicity.BEGIN, *map(ord, word), toxicity.END]
        out = {}
        for i in range(len(padded)):
            for j in range(i + 1, len(padded)):
                for k in range(j + 1, min(i + toxicity.SPAN, len(padded))):
                    key = (padded[i], padded[j], padded[k])
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
        return out

    x, y = counts(a), counts(b)
    norm = lambda z: np.sqrt(sum(v * v for v in z.values()))
    return sum(v * y.get(k, 0) for k, v in x.items()) / norm(x) / norm(y)


def test_kernel_equals_brute_force():
    words = ["idiot", "idxiot", "moron", "table", "stbl", "ab"]
    found = toxicity.counts_of(words)
    merged = []
    for h, v in found:  # counts of equal triples add up
        total = np.zeros(toxicity.DIMENSIONS)
        np.add.at(total, h, v)
        merged.append(total / np.sqrt(total @ total))
    want = np.array([[gapped(a, b) for b in words] for a in words])
    assert np.abs(np.array(merged) @ np.array(merged).T - want).max() < 0.02


def test_landmark_features_reproduce_the_kernel():
    """Nyström: among landmarks themselves products of features are kernel values; folded weights give the same margins."""
    words = ["idiot", "moron", "table", "window"]
    marks = toxicity.Landmarks(words)
    x = np.array([marks.features([w])[:-1] for w in words])
    assert np.allclose(x @ x.T, toxicity.kernel(marks.counts, marks.counts), atol=1e-6)
    model = marks.fitted(np.array([marks.features([w]) for w in words[:2]]), np.array([marks.features([w]) for w in words[2:]]))
    toxic, clean = model.of_texts(["you idxiot", "i d i o t", "an id-iot", "moronn"]), model.of_texts(["a table by the window", "the garden", ""])
    assert min(toxic) > max(clean)
    assert "idiot" in toxicity.worst(model, "The table. An idiot here! A window")[0][1]


def test_instances_hold_all_neighbours():
    text = "One two three four five. Six\nseven; eight, i d i o t x.y one one. end"
    found = toxicity.sentences_of(text)
    assert found[:4] == [["one", "two"], ["two", "three"], ["three", "four"], ["four", "five"]]
    assert {w for own in found for w in own} == set(toxicity.words_of(text)) and ["end"] in found and ["one"] in found
    assert toxicity.sentences_of(" 1 ") == []


def test_hinge_loss_by_coordinates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.sign(x @ np.array([1, -2, 0.5, 0, 1]))
    w = linear.dual_coordinate_descent([(np.arange(5), r) for r in x], y, 5, np.ones(200), epochs=60)
    assert (np.sign(x @ w) == y).mean() > 0.97
    # the loss is no greater than nearby: it is convex, so this is the minimum
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    exact = linear.dual_coordinate_descent([(np.arange(5), r) for r in x], y, 5, np.ones(200), epochs=3000)
    assert all(loss(exact) <= loss(exact + rng.normal(size=5) * step) + 1e-6 for step in (0.5, 0.05, 0.005) for _ in range(50))


EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m.start(), m.end()) for m in re.finditer(EMAIL, text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(IP, text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(CARD, text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m)) <= 15]


def test_base_spans_equal_the_patterns():
    rnd = random.Random(0)
    for _ in range(20000):
        text = "".join(rnd.choice("ab.@-_%+ 0123456789().@.") for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(text) == base(text)


def test_personal_data(spark, tables):
    rows = pii.spans(tables[0]).collect()
    texts = {r["doc_id"]: r["text"] for r in tables[0].collect()}
    for r in rows:
        own = base(texts[r["doc_id"]])
        assert set(pii.written(own).split(",")) <= set(r["spans"].split(",")) | {""}
        assert r["n_email"] == sum(k == "email" for k, *_ in own)
    assert len(pii.spans(odd(spark)).collect()) == 7 and pii.spans(odd(spark).limit(0)).collect() == []
    assert pii.redact("x a@b.cd 1.2.3.4", [("email", 2, 8), ("ip", 9, 16)]) == "x [EMAIL] [IP]"
    clean = pii.redacted(tables[0])
    assert clean.columns == tables[0].columns and not any(re.search(EMAIL, r["text"]) for r in clean.collect())


def jaccard_brute(rows):
    sets, root, links = {}, {}, {}
    for doc, text in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        sets[doc] = {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        root[doc], links[doc] = doc, 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, find(d), links[d]) for d in sets)


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 4}])
def test_ngram_join_equals_brute_force(spark, blocks):
    """Copies, near copies in chains, short and empty texts; also with buckets dealt into many tiles."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcde") for _ in range(4)) for _ in range(300)]
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A, b!"), (5, "a b c d e f")]
    for g in range(6):
        text = [rnd.choice(words) for _ in range(rnd.choice([40, 120]))]
        for _ in range(12):
            copy = list(text)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((10 + len(rows), " ".join(copy)))
            text = copy if rnd.random() < 0.5 else text
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, keys string")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.near_documents(df, **blocks).collect())
    assert got == jaccard_brute(rows)
    again = df.union(df.limit(3)).union(spark.createDataFrame([(None, "q", "x")], df.schema))
    assert ngram_join.near_documents(again, **blocks).count() == len(rows) + 1
    assert ngram_join.near_documents(df.limit(0)).collect() == []


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 5}])
def test_embedding_dedup_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    rows = []
    for i in range(160):
        v = centres[rng.integers(8)] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.5])
        rows.append((i, [float(x) for x in v], int(rng.integers(2))))
    rows += [(200, rows[0][1], rows[0][2]), (201, rows[0][1], rows[0][2]), (202, None, 1), (203, [0.0] * 16, 1), (204, [float("nan")] * 16, 1), (205, rows[1][1], None), (206, [None] + [1.0] * 15, 1), (207, [1.0], 1), (208, [2.0], 1), (209, [], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, size string")
    good = {i: (np.array(v), k) for i, v, k in rows if v and k is not None and None not in v and np.isfinite(v).all() and any(v)}
    near = {(a, b) for a in good for b in good if a != b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.93}
    root = {i: i for i, *_ in rows}
    for _ in range(len(rows)):
        for a, b in near:
            root[a] = min(root[a], root[b])
    want = sorted((i, sum(a == i for a, _ in near), root[i], root[i] == i) for i, *_ in rows)
    assert sorted(map(tuple, embedding_dedup.near_vectors(df, **blocks).collect())) == want
    assert embedding_dedup.near_vectors(df.limit(0)).collect() == []


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(40)] + [(500, x) for x in range(300, 360)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x != r}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in left.collect()}
        left = spark.createDataFrame(stage(spark, left, SF).toPandas(), docs.schema)
        after = {r["doc_id"]: r["text"] for r in left.collect()}
        assert left.columns == docs.columns and set(after) <= set(before)
        if name == "quality classifier":
            assert np.mean([(d in after) == (q == 1) for d, q in labels.items() if d in before]) > 0.95
        elif name == "exact dedup":
            norm = {}
            for d, t in before.items():
                norm.setdefault(re.sub(r"[ \t-\r]", "", t), []).append((-len(t), d))
            assert set(after) == {min(own)[1] for own in norm.values()}
        elif name == "n-gram Jaccard join":
            assert set(after) == {c for _, c, _ in jaccard_brute(before.items())}
        else:
            assert set(after) == set(before) and not any(re.search(EMAIL, t) for t in after.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, left, SF).collect()
    assert {r["doc_id"] for r in packed} == set(after)
