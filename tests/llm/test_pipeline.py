"""The pipeline against plain Python versions of its stages."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tests.llm.test_exact_dedup import brute as copies
from tests.llm.test_jaccard_join import brute as near_copies
from tests.llm.test_mixing import brute as mix
from wetcell.llm import bpe, quality

WORDS = ["the", "of", "and", "river", "meadow", "walking", "to", "in", "quiet", "evening", "was", "seen", "before", "it"]


def corpus():
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(260):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "er"]) for _ in range(rng.randrange(40, 160))]
        good = i % 5 != 0
        docs.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "$$$" for w in words), "en", f"src{i % 4}", 7))
        labels.append((i, int(good), 0))
    for k in range(20):
        text = docs[10 * k + 1][1]
        docs.append((300 + k, text.upper().lower(), "en", "src1", 7))
        docs.append((400 + k, text + " river", "en", "src2", 7))
    docs += [(500, None, "en", None, None), (501, "", None, "src9", 0), (502, docs[2][1], "en", None, 7)]
    return docs, labels


def test_stages_match_plain_versions(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf_dir = str(tmp_path)
    own = spark.read.parquet(f"{sf_dir}/documents.parquet")
    features = spark.createDataFrame([(i, [float(x) for x in quality.text_stats(t)]) for i, t, *_ in docs], "doc_id long, f array<double>")
    model = quality.fit(features, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [d for d in docs if model.score(np.array([quality.text_stats(d[1])]))[0] >= quality.CUT]
    assert len(rows) < len(docs) - 40 and {d[0] for d in docs if d[0] % 5 and d[0] < 260} <= {d[0] for d in rows}
    names = [n for n, _ in corpus_pipeline.STAGES]
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = own.columns
        own = stage(spark, own, sf_dir)
        assert name == names[-1] or own.columns == columns
        own.write.parquet(f"{sf_dir}/{names.index(name)}")
        own = spark.read.parquet(f"{sf_dir}/{names.index(name)}")
        got[name] = own.collect()
    assert sorted(r.doc_id for r in got[names[0]]) == sorted(d[0] for d in rows)
    kept = {i for i, _, _, k, _ in copies([d[:2] for d in rows]) if k}
    rows = [d for d in rows if d[0] in kept]
    assert sorted(r.doc_id for r in got[names[1]]) == sorted(kept)
    kept = {i for i, c, _ in near_copies([d[:2] for d in rows]) if i == c}
    assert len(kept) < len(rows) - 10
    rows = [d for d in rows if d[0] in kept]
    assert sorted(r.doc_id for r in got[names[2]]) == sorted(kept)
    words = defaultdict(int)
    for r in got[names[3]]:
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert dict(words) == {i: n for i, _, _, _, n in mix([(d[0], d[1], d[3]) for d in rows]) if n}
    tok = bpe.tokenizer(bpe.default_path())
    encoded = Counter((r.doc_id, tuple(tok.encode(r.text, add_special_tokens=False).ids)) for r in got[names[3]])
    assert Counter((r.doc_id, tuple(r.ids)) for r in got[names[4]]) == encoded
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in whole) == encoded
