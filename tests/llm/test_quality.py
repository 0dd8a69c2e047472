import binascii
import random

import numpy as np

from wetcell.llm import quality


def corpus():
    rng = random.Random(2)
    words = ["the", "of", "and", "river", "meadow", "walking", "to", "in", "quiet", "evening", "was", "seen", "before", "it"]
    rows, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        text = [rng.choice(words) for _ in range(rng.randrange(30, 300))]
        text = " ".join(text).capitalize() + "." if good else " ".join(w.upper() + rng.choice(["!!", "$$$", " |"]) for w in text)
        rows.append((i, text, "en"))
        if i % 5:
            labels.append((i, int(good)))
    return rows, labels + [(3, None), (None, 1), (10_000, 1), (7, 5)]


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus()
    odd = [(None, "a b", "en"), (2000, None, "en"), (2001, "", "en"), (2002, "word " * 100_000, "en"), (1, rows[1][1], "en")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, f string")
    got = quality.scored(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert r.held_out == (r.doc_id is None or binascii.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.97


def test_held_out_labels_change_nothing(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    flipped = [(i, 1 - q if i is not None and q in (0, 1) and binascii.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    a, b = (quality.scored(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect() for x in (labels, flipped))
    assert {r.doc_id: round(r.score, 9) for r in a} == {r.doc_id: round(r.score, 9) for r in b}


def test_moments_give_the_classes_covariances(spark):
    rows, labels = corpus()
    x = {i: np.array(quality.text_stats(t)) for i, t, _ in rows}
    features = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "doc_id long, f array<double>")
    model = quality.fit(features, spark.createDataFrame(labels, "doc_id long, quality int"), to_pooled=0, to_diagonal=0)
    for c in (0, 1):
        own = np.array([x[i] for i, q in labels if q == c and i in x and binascii.crc32(str(i).encode()) % 5])
        assert np.allclose(model.means[c], own.mean(0))
        assert np.allclose(model.factors[c] @ model.factors[c].T, np.cov(own.T, bias=True) + 1e-6 * np.eye(own.shape[1]), atol=1e-6)


def test_one_label_or_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    got = quality.scored(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")).collect()
    assert [r.score for r in got] == [0.5, 0.5]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.scored(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
