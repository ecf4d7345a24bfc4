"""N-gram Jaccard join, decontamination, substring dedup and the pipeline against plain Python."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from scanfold.llm import components, decontaminate, ngram_join, queries, substring_dedup
from scanfold.sources.workspace import stored
from tests.conftest import SF
from tests.llm.conftest import by_id

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in SPACE.split(low) if w]


def plain_components(pairs, words, percent):
    sets = {}
    for i, text in pairs:
        own = words_of(text)
        k = min(words, len(own))
        sets[i] = {tuple(own[j:j + k]) for j in range(len(own) - k + 1)} if own else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_texts(seed, n=160):
    """Families of texts with a few replaced words, chains whose ends don't link, a passage that half of all share."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = draw.choices(vocabulary, k=40)
    bases = [draw.choices(vocabulary, k=draw.randrange(3, 200)) for _ in range(6)]
    texts = []
    for _ in range(n):
        own = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 2, 3, 5])):
            own[draw.randrange(len(own))] = draw.choice(vocabulary)
        if draw.random() < 0.3:
            own = draw.choices(vocabulary, k=draw.randrange(20))
        if draw.random() < 0.4:
            own += shared
        texts.append(draw.choice([" ", "\n", "\t  "]).join(own))
    return texts


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_near_duplicates(documents, words, percent):
    pairs = list(enumerate(near_texts(words))) + [(900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a  B"), (-5, "a b"), (905, "a b c d"), (906, "É b c d e"),
                                                  (907, " ".join(f"x{i}" for i in range(30_000))), (908, " ".join(f"x{i}" for i in range(29_000)))]
    want = plain_components(pairs, words, percent)
    docs = documents(pairs)
    got = by_id(ngram_join.near_duplicates(docs, words=words, percent=percent))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    left = ngram_join.drop_near_duplicates(docs, words=words, percent=percent)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {c for _, c in want.values()}


def test_near_duplicates_without_rows_or_ids(documents):
    assert ngram_join.near_duplicates(documents([])).count() == 0
    rows = ngram_join.near_duplicates(documents([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (4, "z"), (6, "z")])).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in rows) == [("4", 4), ("4", 4), ("4", 4), ("6", 4), ("None", None)]


def test_tree_finds_all_pairs():
    make = np.random.default_rng(2)
    base = make.poisson(4, (20, ngram_join.GROUPS))
    points = np.maximum(0, base[make.integers(0, 20, 400)] + make.integers(-1, 2, (400, ngram_join.GROUPS)))
    sizes = points.sum(axis=1)
    rows = np.arange(400)
    found = {tuple(sorted(p)) for x, y in ngram_join.tree_pairs(points, sizes, rows, rows, 85) for p in zip(x.tolist(), y.tolist())}
    bound = np.minimum(points[:, None], points[None]).sum(axis=2)
    fits = (185 * bound >= 85 * (sizes[:, None] + sizes[None])) & (100 * np.minimum(sizes[:, None], sizes[None]) >= 85 * np.maximum(sizes[:, None], sizes[None]))
    assert found == {(i, j) for i, j in zip(*np.nonzero(fits)) if i < j} and found


def test_tiles_find_links_that_the_first_node_misses(documents, monkeypatch):
    """A chain of texts in which each links with the next only, cut into tiles of a few nodes."""
    monkeypatch.setattr(ngram_join, "TILE", 4)
    draw = random.Random(8)
    own = [f"w{i}" for i in range(150)]
    pairs = []
    for i in range(40):
        pairs.append((i * 7 % 41, " ".join(own)))
        for _ in range(3):
            own[draw.randrange(150)] = f"n{i}-{draw.random()}"
    got = by_id(ngram_join.near_duplicates(documents(pairs)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == plain_components(pairs, 4, 85)


def test_components(spark):
    draw = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100 + draw.randrange(50), 100 + draw.randrange(50)) for _ in range(30)] + [(7, 7), (1000, 200), (1000, 201)]
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(documents, spark):
    draw = random.Random(6)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [draw.choices(vocabulary, k=n) for n in (50, 30, 15, 8, 5, 1, 0)]
    benchmark = spark.createDataFrame([(i, " ".join(x), 3) for i, x in enumerate(items)] + [(99, None, 1)], "item_id long, text string, h int")
    filler = [f"f{i}" for i in range(500)]

    def around(own):
        return ", ".join(draw.choices(filler, k=60)).upper() + "\n" + " ".join(own) + " " + ". ".join(draw.choices(filler, k=40))

    replaced = list(items[0])
    replaced[7:50:9] = ["other"] * len(replaced[7:50:9])
    pairs = [(1, around(items[0])), (2, around(replaced)), (3, around([w.upper() + "!" for w in items[1]])), (4, around(items[0][:12])), (5, around(items[2])),
             (6, around(items[3])), (7, around(items[4])), (8, around(items[1] + items[2])), (9, around([])), (10, around(items[0][10:40])), (11, None), (12, ""), (None, around(items[0])),
             (13, around(items[4][:4])), (14, " ".join(items[0])), (15, around(items[2][:-1])), (16, around(filler * 200 + items[1]))]
    docs = documents(pairs)
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert found == {(1, 0), (2, 0), (3, 1), (5, 2), (6, 3), (7, 4), (8, 1), (8, 2), (10, 0), (14, 0), (15, 2), (16, 1)}
    row = decontaminate.contaminated(docs, benchmark).filter("doc_id = 1").first()
    assert (row.doc_word, row.item_word, row.n_words, row.n_equal) == (60, 0, 50, 50)
    left = decontaminate.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {4, 9, 11, 12, 13}
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.contaminated(documents([]), benchmark).count() == 0


def test_masks_lose_nothing():
    """However a fifth of a stretch's words are replaced, a mask fits somewhere between them."""
    masks = [sum(1 << i for i in m) for m in decontaminate.MASKS]
    for size, replaced in ((8, 1), (10, 2), (13, 2), (15, 3), (20, 4), (25, 5)):
        for places in itertools.combinations(range(size), replaced):
            gone = sum(1 << i for i in places)
            assert any(not m << p & gone for m in masks for p in range(size - m.bit_length() + 1)), (size, places)


def holds(item, text, least=decontaminate.LEAST_WORDS):
    """Whether some stretch along some diagonal is equal enough and has words enough, by trying all."""
    wanted = min(least, -(-4 * len(item) // 5)) if len(item) >= 8 else len(item)
    for d in range(1 - len(item), len(text)):
        same = [0]
        for i, w in enumerate(item):
            same.append(same[-1] + (0 <= i + d < len(text) and text[i + d] == w))
        if any(same[j] - same[i] >= wanted and 5 * (same[j] - same[i]) >= 4 * (j - i) for i in range(len(item)) for j in range(i + wanted, len(item) + 1)):
            return True
    return False


def test_decontamination_against_all_stretches(spark):
    """Every single replaced word and a fifth or more at random, in items of 8 to 50 words."""
    draw = random.Random(8)
    vocabulary, filler = [f"v{i}" for i in range(60)], [f"f{i}" for i in range(40)]
    docs, items = {}, {n: draw.choices(vocabulary, k=n) for n in (3, 7, *range(8, 19), 20, 25, 26, 30, 40, 50)}
    for n, item in items.items():
        ways = [{i} for i in range(n)] + [set(draw.sample(range(n), k)) for k in {n // 5, n // 5 + 1, n // 3} for _ in range(6)]
        for places in ways:
            own = [draw.choice(filler) if i in places else w for i, w in enumerate(item)]
            cut = draw.choice([0, 0, 0, draw.randrange(n)])
            docs[len(docs)] = (n, draw.choices(filler + vocabulary[:9], k=draw.randrange(12)) + own[cut:] + draw.choices(filler, k=draw.randrange(9)))
    found = decontaminate.contaminated(spark.createDataFrame([(i, " ".join(t)) for i, (_, t) in docs.items()], "doc_id long, text string"),
                                       spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string")).collect()
    own = {(r.doc_id, r.item_id) for r in found}
    want = {(i, n) for i, (n, text) in docs.items() if holds(items[n], text)}
    assert {(i, n) for i, n in own if docs[i][0] == n} == want and 300 < len(want) < len(docs)
    for r in found:
        item, text = items[r.item_id], docs[r.doc_id][1]
        same = sum(0 <= r.doc_word + i < len(text) and text[r.doc_word + i] == item[r.item_word + i] for i in range(r.n_words))
        assert same == r.n_equal and 5 * same >= 4 * r.n_words and holds(item, text)


def test_decontamination_of_table(spark):
    """Every document that has most five-word shingles of an item is found, and no other."""
    def split(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    def shingles(w):
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    items = {r.item_id: shingles(split(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r.doc_id: shingles(split(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(d, i) for d, s in docs.items() for i, t in items.items() if len(s & t) >= 0.8 * len(t)}
    some = {(d, i) for d, s in docs.items() for i, t in items.items() if s & t}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op3_decontaminate"](spark, SF).collect()}
    assert want and want <= got <= some


def test_repeated_passages(documents):
    draw = random.Random(12)
    vocabulary = [f"v{i}" for i in range(5000)]

    def prose(n):
        return draw.choices(vocabulary, k=n)

    passage, other = prose(70), prose(60)
    fuzzy = list(passage)
    fuzzy[20] = "changed"
    fuzzy[45:46] = []
    fuzzy[60:60] = ["two", "more"]
    texts = {1: prose(30) + passage + prose(50), 2: prose(80) + passage + prose(10), 3: fuzzy, 4: prose(200), 5: other + prose(30), 6: prose(500) + other, 7: prose(20) + other[:20] + prose(20)}
    texts |= {8: prose(15_000) + passage}
    pairs = [(i, " ".join(w)) for i, w in texts.items()] + [(9, None), (10, ""), (None, " ".join(passage)), (2, " ".join(texts[2])), (11, "x " * 500), (12, "x " * 500)]
    rows = substring_dedup.repeated_passages(documents(pairs)).collect()
    found = {(r.doc_id, r.source_id): r for r in rows}
    assert set(found) - {(12, 11)} == {(2, 1), (3, 1), (6, 5), (8, 1)}
    assert (found[2, 1].start_word, found[2, 1].end_word, found[2, 1].source_start, found[2, 1].share) == (80, 150, 30, 1.0)
    # The eight words after the last insertion are too few for a seed that all windows choose.
    assert found[3, 1].end_word - found[3, 1].start_word >= 60 and 0.9 < found[3, 1].share < 1
    assert substring_dedup.repeated_passages(documents([])).count() == 0


def test_chains_against_all_predecessors():
    """The Fenwick tree's best chain scores as one found by looking at every predecessor."""
    draw = random.Random(1)
    k, cost = substring_dedup.K, substring_dedup.GAP_COST
    for _ in range(60):
        matches = sorted({(draw.randrange(60), draw.randrange(60)) for _ in range(draw.randrange(1, 25))})
        source, document = (np.array(x) for x in zip(*matches))

        def gain(j, i):
            ds, dd = source[i] - source[j], document[i] - document[j]
            return min(k, ds, dd) - cost * (max(0, ds - k) + max(0, dd - k)) if ds > 0 and dd > 0 else None

        chosen = substring_dedup.chains(source, document)
        assert sorted(i for c in chosen for i in c.tolist()) == list(range(len(matches)))
        assert all(gain(a, b) is not None for c in chosen for a, b in zip(c[:-1], c[1:]))


def test_passages_of_table(spark):
    """Documents that share a run of fifty words with an earlier one are all found."""
    first, want = {}, set()
    for row in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        own = words_of(row.text)
        runs = [tuple(own[i:i + 50]) for i in range(len(own) - 49)]
        if any(first.get(r, row.doc_id) != row.doc_id for r in runs):
            want.add(row.doc_id)
        for r in runs:
            first.setdefault(r, row.doc_id)
    got = {r.doc_id for r in queries.QUERIES["op8_substring_dedup"](spark, SF).collect()}
    assert want and want <= got


def test_jaccard_of_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLE["op2_ngram_jaccard"]).fetchall()
    got = queries.QUERIES["op2_ngram_jaccard"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stored(stage(spark, docs, SF), "test-stage")
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= set(before)
        if name == "exact_dedup":
            texts = {}
            for i in sorted(before):
                texts.setdefault(SPACE.sub(" ", before[i] or ""), i)
            assert after == set(texts.values())
        if name == "ngram_jaccard":
            assert after == {c for _, c in plain_components(list(before.items()), 5, 80).values()}
        if name == "bpe":
            assert after == set(before) and docs.columns[0] == "doc_id"
        else:
            assert docs.columns == columns
    assert len(after) > 100
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == after
