import random
import re

from wetcell.llm import licenses


def dice(a, b):
    pairs = lambda t: {p for w in [re.findall(r"\w+", t.lower())] for p in zip(w, w[1:], strict=False)}
    x, y = pairs(a), pairs(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def brute(text):
    lines = (text or "").split("\n")
    full = [bool(re.search(r"\w", x)) for x in lines]
    units = {(i, i) for i in range(len(lines))}
    runs = [(a, b) for a in range(len(lines)) for b in range(a, len(lines)) if all(full[a : b + 1]) and (a == 0 or not full[a - 1]) and (b == len(lines) - 1 or not full[b + 1])]
    units |= set(runs)
    if len(runs) > 1:
        units.add((0, len(lines) - 1))
    out = []
    for a, b in sorted(units):
        scores = sorted(((-dice("\n".join(lines[a : b + 1]), t), n) for n, t in licenses.TEMPLATES.items()))
        if -scores[0][0] >= licenses.LEAST:
            out.append((scores[0][1], a, b, round(-scores[0][0], 9)))
    return out


def test_matches_brute_force(spark):
    mit, gpl = licenses.TEMPLATES["MIT text"], licenses.TEMPLATES["GPL-3.0"]
    wrapped = "\n".join(mit.split(", "))
    texts = [
        None, "", "one", "some words\n" + gpl.upper() + "\nmore words", wrapped, wrapped + "\n\nother words here", mit.replace("Software", "Work"),
        "Released under the MIT License", "released, under: the -- mit license!\n\n\nReleased under the BSD License", "nothing here " * 50_000,
        gpl + "\n" + gpl, "Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-NC 4.0.", " ".join(licenses.TEMPLATES.values()),
    ]
    rows = [(i, t, "m") for i, t in enumerate(texts)] + [(None, gpl, "m"), (3, texts[3], "m")]
    got = licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string, matches string"), windows=False).collect()
    found = sorted(((r.doc_id, [(m.license, m.first, m.last, round(m.dice, 9)) for m in r.matches]) for r in got), key=str)
    assert found == sorted(((i, brute(t)) for i, t, _ in rows), key=str)
    assert sum(bool(m) for _, m in found) >= 9


def test_every_template_finds_itself(spark):
    rows = [(i, "x\n" + t) for i, t in enumerate(licenses.TEMPLATES.values())]
    got = licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.matches[0].license for r in got} == dict(enumerate(licenses.TEMPLATES))


def test_empty_table(spark):
    assert licenses.license_matches(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_windows_match_brute_force_over_all_word_windows():
    rng = random.Random(6)
    template = "a b c d e f"
    matcher = licenses.Matcher({"t": template}, licenses.LEAST)
    other, some = set(zip(template.split(), template.split()[1:], strict=False)), 0
    for _ in range(400):
        words = [w for _ in range(6) for w in (template.split() if rng.random() < 0.4 else rng.choices("abcdefx", k=3))]
        pairs = list(zip(words, words[1:], strict=False))
        every = []
        for i in range(len(pairs)):
            for j in range(i, len(pairs)):
                own = set(pairs[i : j + 1])
                d = 2 * len(own & other) / (len(own) + len(other))
                if d >= licenses.LEAST:
                    every.append((-d, j - i, i, len(own & other)))
        want = licenses.apart(sorted(every))
        got = licenses.apart(matcher.candidates(pairs, [i for i, p in enumerate(pairs) if p in other], other))
        assert got == want
        some += bool(want)
    assert some > 100


def test_spans_that_meet_are_one():
    rng = random.Random(1)
    spans, taken = licenses.Spans(), set()
    for _ in range(500):
        a = rng.randrange(2000)
        b = a + rng.randrange(4)
        assert spans.free(a, b) == taken.isdisjoint(range(a, b + 1))
        if rng.random() < 0.5:
            spans.add(a, b)
            taken.update(range(a, b + 1))
    assert spans.starts == sorted(spans.starts) and all(x < y for x, y in zip(spans.ends, spans.starts[1:], strict=False))


def test_texts_with_very_many_notices():
    texts = list(licenses.TEMPLATES.values())
    found = licenses.Matcher(licenses.TEMPLATES, licenses.LEAST).matches("\n".join(texts[i % len(texts)] for i in range(2000)))
    assert len(found) == 2000 and all(m["first"] == m["last"] == i for i, m in enumerate(found))


def test_the_query_finds_notices_inside_lines_and_paragraphs(spark, tmp_path):
    mit = licenses.TEMPLATES["MIT text"]
    prose = " ".join(f"w{i}" for i in range(400)) + " "
    texts = [prose + mit + prose, "first line\n" + "\n".join(mit.split(", ")) + "\n" + prose, " ".join(licenses.TEMPLATES.values()), prose, mit, None, "permission is " * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in licenses.op10_license_scans(spark, str(tmp_path)).collect()}
    last = len(mit.split(", "))
    assert [(got[i].n_matches, got[i].license, got[i].spans) for i in (0, 1, 4)] == [(1, "MIT text", "MIT text:0:0"), (1, "MIT text", f"MIT text:1:{last}"), (1, "MIT text", "MIT text:0:0")]
    assert got[2].n_matches == len(licenses.TEMPLATES) and {x.rsplit(":", 2)[0] for x in got[2].spans.split(",")} == set(licenses.TEMPLATES)
    assert [got[i].n_matches for i in (3, 5, 6)] == [0, 0, 0]
