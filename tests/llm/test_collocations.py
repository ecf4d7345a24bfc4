"""Collocations against brute force, with and without room for all numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scanfold.llm import collocations as C


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, least=10, kept=2000):
    f, n, found = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(words[i:i + size] for i in range(len(words) - size + 1))
    for lang, own in f.items():
        kept_rows = []
        longer = Counter()
        for phrase, a in own.items():
            if len(phrase) == 3 and a >= least:
                for inner in (phrase[:2], phrase[1:]):
                    longer[inner] = max(longer[inner], a)
        for phrase, a in own.items():
            if len(phrase) == 1 or a < least or (len(phrase) == 2 and longer[phrase] and 100 * longer[phrase] >= 50 * a):
                continue
            cuts = [(1_000_000 * a * a // (own[phrase[:k]] * own[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            kept_rows.append((score, a, " ".join(phrase), own[phrase[:k]], own[phrase[k:]]))
        kept_rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        found += [(lang, i, phrase, a, left, right, n[lang], score) for i, (score, a, phrase, left, right) in enumerate(kept_rows[:kept], 1)]
    return sorted(found)


def corpus(seed, documents=60, words=40):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "x-y", "ß"]
    rows = []
    for _ in range(documents):
        text = ""
        while len(text) < 600:
            text += draw.choice(vocabulary[:int(len(vocabulary) * draw.random() ** 2) + 1])
            text += draw.choice([" ", " ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", " new york city ", " New York ", " a b a b ", "?!"])
        rows.append((draw.choice(["en", "de", None, "und"]), text))
    return rows + [(None, None), ("fr", ""), ("en", " . ,"), ("it", "one two"), ("en", "long " * 30_000)]


def told(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


def frame(spark, rows):
    return spark.createDataFrame([(lang, text, "x", 5) for lang, text in rows], "lang string, text string, phrase string, a int")


def test_against_brute_force(spark):
    rows = corpus(1)
    got = told(C.collocations(frame(spark, rows)))
    assert len(got) > 100 and got == brute(rows)


@pytest.mark.parametrize("most_words, most_pairs", [(7, C.MOST_PAIRS), (C.MOST_WORDS, 9), (12, 5), (1, 1)])
def test_what_has_no_number_is_counted_too(spark, most_words, most_pairs):
    rows = corpus(2, 30, 25)
    assert told(C.collocations(frame(spark, rows), most_words=most_words, most_pairs=most_pairs)) == brute(rows)


def test_repeated_rows_and_few_kept(spark):
    rows = corpus(3, 10, 8) * 3
    got = told(C.collocations(frame(spark, rows), least=5, kept=7))
    assert got == brute(rows, 5, 7) and {r[1] for r in got} == set(range(1, 8))


def test_empty(spark):
    assert C.collocations(frame(spark, [])).count() == 0
    assert C.collocations(frame(spark, [("en", None)])).count() == 0


def test_tiles(monkeypatch):
    monkeypatch.setattr(C, "DENSE_FROM", 50)
    draw, tiles, got = np.random.default_rng(4), C.TileCounts(), Counter()
    want = Counter()
    for _ in range(5):
        left, right = (draw.geometric(0.002, 3000) % (1 << C.WORD_BITS) for _ in range(2))
        want.update(zip(left.tolist(), right.tolist()))
        for x, y, n in zip(*(v.tolist() for v in tiles.add(left, right))):
            got[x, y] += n
    assert tiles.dense and len(tiles.dense) <= C.DENSE_TILES
    for columns in tiles.totals():
        for x, y, n in zip(*(v.tolist() for v in columns)):
            got[x, y] += n
    assert got == want


def test_scores_pass_64_bits(spark):
    rows = [(3_000_000_000, 4_000_000_000, 3_500_000_001), (12, 12, 12)]
    got = spark.createDataFrame(rows, "a long, l long, r long").selectExpr(C._score("a", "l", "r") + " AS s").collect()
    assert [r.s for r in got] == [1_000_000 * a * a // (x * y) for a, x, y in rows]
