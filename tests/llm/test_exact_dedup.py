import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from scanfold.llm import exact_dedup
from tests.conftest import SF
from tests.llm.conftest import by_id


def brute(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    found = {}
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            found[i] = (keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest())
    return found


PAIRS = [(5, "a  b"), (3, "a\tb"), (9, " a b"), (1, None), (2, ""), (7, " "), (8, "x" * 300_000), (4, "x" * 300_000),
         (11, "a b"), (-2, "a b"), (None, "lone")]


def test_groups(documents):
    got = {k: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for k, r in by_id(exact_dedup.exact_groups(documents(PAIRS))).items()}
    assert got == brute(PAIRS)


def test_equal_hashes_are_told_apart(documents):
    got = exact_dedup.exact_groups(documents(PAIRS), hash_of=lambda t: F.unhex(F.lit("00")))
    assert {k: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for k, r in by_id(got).items()} == brute(PAIRS)


def test_rows_left(documents, spark):
    pairs = [*PAIRS, (3, "a\tb"), (-2, "a b"), (-2, "a b")]
    left = exact_dedup.drop_exact_duplicates(documents(pairs))
    assert left.columns == documents(PAIRS).columns
    assert sorted((str(r.doc_id), r.hash, r.content) for r in left.collect()) == sorted(
        (str(i), "x", 7) for i in (-2, 9, 1, 7, 4, 11, None))
    assert exact_dedup.drop_exact_duplicates(documents([])).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {k: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for k, r in by_id(exact_dedup.exact_groups(docs)).items()} == want
