import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loupe.llm import toxicity
from loupe.llm.queries import QUERIES
from loupe.llm.toxicity import STRIDE, WINDOW, Model, Network, bare, fit_toxicity, score_toxicity, train, trigrams, window_starts, words_of

SF = "/root/testdata/sf0.1"


def small_net(dtype=np.float64):
    return Network({"a": 1, "b": 2, "c": 3}, seed=3, dtype=dtype)


def test_gradients_equal_finite_differences():
    net, words = small_net(), ["a", "b", "zebra", "c"]
    rng = np.random.default_rng(0)
    index = rng.integers(0, 4, (3, 5))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 0, 0, 0], [1, 1, 1, 1, 0]], float)
    labels, weights = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    _, grads = net.gradients(words, index, mask, labels, weights)
    for name, g in grads.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in g.shape) if name not in ("words", "chars") else tuple(
                x[0] for x in np.nonzero(g)) if rng.random() < 0.5 else tuple(x[-1] for x in np.nonzero(g))
            keep, e = net.p[name][at], 1e-5
            net.p[name][at] = keep + e
            up = net.gradients(words, index, mask, labels, weights)[0]
            net.p[name][at] = keep - e
            down = net.gradients(words, index, mask, labels, weights)[0]
            net.p[name][at] = keep
            assert (up - down) / (2 * e) == pytest.approx(float(g[at]), rel=1e-4, abs=1e-8), name


def plain_logit(net, words):
    """One window, step by step."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    x = []
    for w in words:
        grams, _ = trigrams([w])
        x.append(np.concatenate([net.p["words"][net.vocabulary.get(w, 0)], net.p["chars"][grams].mean(axis=0)]))
    both = []
    for k, seq in ((0, x), (1, x[::-1])):
        h, out = np.zeros(toxicity.HIDDEN), []
        for v in seq:
            n = toxicity.HIDDEN
            g, a = v @ net.p["w"][k] + net.p["b"][k], h @ net.p["u"][k]
            z, r = sig(g[:n] + a[:n]), sig(g[n:2 * n] + a[n:2 * n])
            c = np.tanh(g[2 * n:] + r * a[2 * n:])
            h = (1 - z) * c + z * h
            out.append(h)
        both.append(out if k == 0 else out[::-1])
    states = np.concatenate(both, axis=1)
    e = states @ net.p["attend"]
    alpha = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    return float(alpha @ states @ net.p["out"] + net.p["bias"][0])


def test_windows_cover_whole_texts_and_equal_the_plain_network():
    net = small_net(np.float32)
    model = Model(net, (1.0, 0.0))
    rng = random.Random(4)
    texts = [" ".join(rng.choice("a b c dd eee fff.".split()) for _ in range(n)) for n in (1, 5, 31, 32, 33, 56, 57, 300)]
    for t, b in zip(texts, model.highest(texts, {})):
        words = [bare(w) for w in words_of(t)]
        starts = window_starts(len(words))
        assert set(range(len(words))) <= {i for s in starts for i in range(s, s + WINDOW)}
        assert all(y - x == STRIDE < WINDOW for x, y in zip(starts, starts[1:]))
        assert b == pytest.approx(max(plain_logit(net, words[s:s + WINDOW]) for s in starts), abs=1e-4)


def test_a_toxic_passage_in_a_long_text_and_odd_texts():
    rng = random.Random(1)
    clean = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "and", "of"]) + rng.choice("abcde") for _ in range(n))
    texts, labels = [], []
    for i in range(400):
        t = clean(rng.randrange(5, 200)).split()
        if i % 4 == 0:
            t.insert(rng.randrange(len(t)), rng.choice(["awful", "Horrid!", "vile,"]))
        texts.append(t and words_of(" ".join(t)))
        labels.append(int(i % 4 == 0))
    model = train(texts, labels, 0.25)
    long_clean = clean(20000)
    at = len(long_clean) // 2
    s = model.score([long_clean[:at] + " vile " + long_clean[at:], clean(50), "you are AWFUL", "", None, "\n"])
    assert s[0] > 0.3 and s[2] > 0.3 and s[1] < 0.3 and s[3] == s[4] == s[5] and ((s >= 0) & (s <= 1)).all()
    assert np.allclose(train([["x"]] * 5, [0] * 5, 0.0).score(["anything"]), 0.001)


def test_passages_far_into_labelled_and_scored_texts(spark):
    """A quarter of the labelled texts hold a toxic passage, half of them at word 15,000 of a long text."""
    rng = random.Random(6)
    clean = lambda n: [rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + rng.choice("abcde") for _ in range(n)]
    passage = lambda: [rng.choice(["awful", "horrid", "vile", "you", "are"]) for _ in range(40)]
    before = lambda i: 15000 if i % 8 == 0 else 100
    docs = [(i, " ".join(clean(before(i)) + passage() + clean(20) if i % 4 == 0 else clean(15000 if i % 8 == 1 else 300))) for i in range(240)]
    docs += [(1000 + i, " ".join(clean(15000) + passage() + clean(5))) for i in range(4)] + [(2000 + i, " ".join(clean(15045))) for i in range(4)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in score_toxicity(frame, fit_toxicity(frame, labels)).where("doc_id >= 1000").select("doc_id", "score").collect()}
    assert min(got[1000 + i] for i in range(4)) > 0.3 > max(got[2000 + i] for i in range(4))


def test_repeated_ids_send_one_text_each_to_the_driver(spark, monkeypatch):
    import loupe.llm.toxicity as tox
    seen = []
    monkeypatch.setattr(tox, "train", lambda texts, labels, share: seen.append((texts, labels)))
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(3, "other")], "doc_id long, text string")
    tox.fit_toxicity(docs, spark.createDataFrame([(1, 1), (3, 0), (3, 0)], "doc_id long, toxic int"))
    assert sorted(map(len, seen[0][0])) == [1, 2] and sorted(seen[0][1]) == [0, 1]


def test_held_out_accuracy_and_contract(spark):
    rows = QUERIES["op6_toxicity"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").toPandas()
    assert sorted(rows.doc_id) == sorted(docs.doc_id)
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in rows.doc_id]).all()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    known = rows.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    known = known[known.held_out]
    y, rank = known.toxic.to_numpy(), known.score.rank().to_numpy()
    n = y.sum()
    auc = (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))
    assert auc > 0.95
    hit = known.predicted.to_numpy() == 1
    assert (hit & (y == 1)).sum() / n > 0.9 and (hit & (y == 0)).sum() / (len(y) - n) < 0.03


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(1, "fine words here"), (2, None), (None, "words"), (3, ""), (4, "word " * 100000), (1, "fine words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "label": F.lit(5), "words": F.lit(1)})
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (9, 1), (4, None)], "doc_id long, toxic int").withColumn("text", F.lit("y"))
    model = fit_toxicity(docs, labels)
    got = score_toxicity(docs, model)
    assert got.columns == ["doc_id", "text", "score", "label", "words"] and got.count() == 6
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert score_toxicity(docs.limit(0), model).collect() == []
    empty = fit_toxicity(docs.limit(0), labels.limit(0))
    assert score_toxicity(docs, empty).where("score is null").count() == 0


def test_calibration_of_classes_far_apart():
    """Whole Newton steps swing for ever on these logits and end at a constant score."""
    for seed in (54, 89, 182, 211, 234, 259, 322, 335, 412, 442):
        rng = np.random.default_rng(seed)
        n_toxic, n_clean = rng.integers(20, 300), rng.integers(50, 600)
        toxic, clean, spread = rng.uniform(1, 60), rng.uniform(-60, -1), rng.uniform(0.1, 4)
        best = np.concatenate([rng.normal(toxic, spread, n_toxic), rng.normal(clean, spread, n_clean)])
        y = np.concatenate([np.ones(n_toxic), np.zeros(n_clean)])
        odd = rng.random(len(best)) < 0.01
        best[odd] = rng.normal(0, 20, odd.sum())
        share = rng.uniform(0.05, 0.3)
        weights = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y).mean())
        a, c = toxicity._calibrate(best, y, weights)
        p = toxicity.sigmoid(a * best + c)
        assert a > 0 and ((p >= toxicity.THRESHOLD) == (y == 1)).mean() > 0.95
        gradient = np.array([(weights * (p - y) * best).sum() + 0.1 * a, (weights * (p - y)).sum() + 0.01 * c])
        assert np.abs(gradient).max() < 1e-5
