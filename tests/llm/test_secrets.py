import hashlib
import random
import re

import numpy as np

from wetcell.llm import secrets

ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


def brute(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.A) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def test_spans_match_brute_force(spark, tmp_path):
    rng = random.Random(3)
    words = ["ordinary", "identifier", "naming", "schedule", "vocabulary", "transition", "configuration"]
    plain = [" ".join(rng.choice(words) + rng.choice(words) for _ in range(300)) for _ in range(20)]
    key = "".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(40))
    texts = [
        None, "", "PassWord = 'abcdef012345678' x", "API_KEY:short", "token=Kabc", "secret: secret=0123456789abcdef0",
        "AKIA" + "A" * 14 + "AKIA", "ſecret=0123456789ab", "deadbeefdeadbeefg0123456789abcdef", f"é key {key} here", "x" * 200_000,
    ] + plain + [f"password={''.join(rng.choice(secrets.ALPHABET[:62]) for _ in range(24))} end" for _ in range(30)]
    rows = [(i, t, "noise") for i, t in enumerate(texts)] + [(None, "token=0123456789abcdef", "noise"), (2, texts[2], "noise")]
    spark.createDataFrame(rows, "doc_id long, text string, base string").write.parquet(f"{tmp_path}/documents.parquet")
    got = secrets.op2_secret_scans(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts_of = {i: t or "" for i, t, _ in rows}
    for r in got:
        want = brute(texts_of[r.doc_id])
        joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in want) for x in range(3)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
        extra = [x for x in r.spans.split(",") if x.startswith("markov")]
        # a token of 18 characters counts too: the value in "\u017fecret=0123456789ab", which no base pattern takes
        found = {texts.index(f"é key {key} here"): [f"markov:6:{6 + len(key)}"], texts.index("\u017fecret=0123456789ab"): ["markov:1:19"]}
        assert extra == found.get(r.doc_id, [])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.secret_spans(empty).count() == 0


def words_and_secrets(seed):
    rng = random.Random(seed)
    parts = "get set user name count index value buffer stream parse render update config schema vector matrix node tree list map time date file path open close read write total score".split()
    join = [lambda p: "_".join(p), lambda p: p[0] + "".join(x.title() for x in p[1:]), lambda p: ".".join(p), lambda p: "-".join(p), lambda p: "".join(x.title() for x in p) + str(rng.randrange(100))]
    names = [rng.choice(join)([rng.choice(parts) for _ in range(rng.randrange(2, 7))]) for _ in range(3000)]
    kinds = (secrets.ALPHABET[:62], secrets.ALPHABET[:64], "0123456789abcdef" + "GHJK")
    return names, ["".join(rng.choice(kinds[i % 3]) for _ in range(rng.randrange(12, 40))) for i in range(600)]


def test_held_out_secrets_and_identifiers():
    """Chains of one sample, tried on another: random strings from 12 characters on, and long identifiers."""
    names, values = words_and_secrets(1)
    counts = secrets.samples_of(" ".join(names) + "".join(f"\npassword={v}" for v in values))
    ratios = secrets.log_ratios(counts)
    names, values = words_and_secrets(2)
    hit = lambda x: secrets.random_spans(f"é {x} .", [], ratios, secrets.ODDS) == [(2, 2 + len(x))]
    assert sum(map(hit, values)) / len(values) > 0.97
    assert sum(map(hit, (v for v in values if len(v) < 20))) > 0.9 * sum(len(v) < 20 for v in values)
    assert sum(map(hit, names)) / len(names) < 0.01


def brute_random(text, spans, ratios, odds):
    """Token by token, in plain Python."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", text):
        if not any(s < m.end() and m.start() < e for s, _, e, _ in spans):
            ids = [secrets.ALPHABET.index(c) + 1 for c in m[0]]
            pairs = {a * len(secrets.ALPHABET) + a + b for a, b in zip(ids, ids[1:], strict=False)}
            if sum(ratios[p] for p in pairs) >= max(odds, len(pairs)):
                out.append(m.span())
    return out


def test_random_spans_match_brute_force():
    names, values = words_and_secrets(3)
    rng = random.Random(4)
    ratios = secrets.log_ratios(secrets.samples_of(" ".join(names) + "".join(f"\ntoken: {v}" for v in values)))
    odd = ["", "日本語", "a", "token=" + values[0], "AKIA" + "Z9" * 9, "0123456789abcdef" * 3, "\udc00", "x" * 5000]
    for _ in range(60):
        text = rng.choice(["", " ", "é"]).join(rng.choice(rng.choice((names, values, odd))) + rng.choice([" ", "\n", "|", ","]) for _ in range(40))
        spans = secrets.base_spans(text)
        assert secrets.random_spans(text, spans, ratios, secrets.ODDS) == brute_random(text, spans, ratios, secrets.ODDS)


def test_many_spans_in_one_text():
    text = "token=0123456789abcdef " * 20_000
    assert len(secrets.base_spans(text)) == 40_000
    assert secrets.random_spans(text, secrets.base_spans(text), np.ones(len(secrets.log_ratios(secrets.samples_of("")))), secrets.ODDS) == []
