"""Secret scan, toxicity, URL filter and chat format against plain Python."""

import hashlib
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanfold.llm import chat_format, secret_scan, toxicity, url_filter
from scanfold.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.conftest import by_id


def plain_spans(text):
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)), found


def test_secrets(documents, spark):
    draw = random.Random(4)
    random_text = "".join(draw.choices(string.ascii_letters + string.digits, k=40))
    texts = ["é token = 'abc' secret: \"abcdef\" PassWord=x.y-z_1", "AKIA" + "A1" * 8 + " AKIASHORT AKIAAKIA" + "B2" * 8, "f" * 24 + "g" + "0" * 23,
             "API_KEY=" + "ab12" * 10, "apiKey:" + "00" * 20, None, "", "ſecret=abcdefgh toKen=abcdefgh", f"look at {random_text} here",
             "plain words and some_ordinary_identifier_name or another-ordinary-path/of/words", "long " * 50_000 + "secret=abcdef"]
    pairs = list(enumerate(texts)) + [(90, texts[0]), (None, texts[1])]
    docs = documents(pairs + [(1000 + i, "the reader counts ordinary_identifiers in threatening_sentences again") for i in range(40)])
    got = by_id(secret_scan.secret_digest(docs))
    for i, text in pairs:
        told, found = plain_spans(text or "")
        row = got[i]
        assert row["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == tuple(sum(k == x for _, k, _ in found) for x in range(3))
        assert ",".join(x for x in row["spans"].split(",") if not x.startswith("random")) == told
    assert got[8]["spans"] == "random:8:48" and got[9]["spans"] == "" and got[1005]["n_random"] == 0
    assert secret_scan.secret_digest(documents([])).count() == 0


def test_secrets_of_table(spark):
    got = by_id(QUERIES["op1_secret_scan"](spark, SF))
    for row in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert got[row.doc_id]["base_sha256"] == hashlib.sha256(plain_spans(row.text or "")[0].encode()).hexdigest()


def test_maximal_segments():
    """Against the definition: take the best segment, then those on either side of it."""
    def slow(scores, at=0):
        best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        _, _, i, j = best
        return slow(scores[:i], at) + [(at + i, at + j)] + slow(scores[j:], at + j)

    draw = random.Random(2)
    for _ in range(200):
        scores = [draw.uniform(-1, 1) for _ in range(draw.randrange(12))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(np.array(scores))] == slow(scores)


def test_words_of_toxicity_in_bulk():
    """Words, places and buckets that are worked on together are those found one by one."""
    draw = random.Random(3)
    texts = ["", "Ab\x1cabc_abcd9abcdefghij", "Straße naïve ÉA 日本語 x²y٣z", "İstanbul 𝔘x \u0345a"]
    texts += ["".join(draw.choices("abcXYZ é_9\n日", k=draw.randrange(60))) for _ in range(300)]
    for text in texts:
        assert toxicity.words_of(text) == toxicity.WORD.findall(text.lower())
        assert list(zip(*(x.tolist() for x in toxicity.places_of(text)))) == [(m.start(), m.end()) for m in toxicity.WORD.finditer(text)]
    words = list({"", "abcdefgé", "a" * 500}.union(*map(toxicity.words_of, texts)))
    assert [[b for b in row if b >= 0] for row in toxicity.buckets_of(words).tolist()] == [toxicity.tokens_of(w) for w in words]
    model = toxicity.ToxicityModel(np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32), 0.05, 1.0, 1.0, np.zeros(4))
    known = toxicity.WordWeights(model)
    for _ in range(2):
        for word, (got,) in zip(words, known.of([[w] for w in words])):
            own = model.weights[toxicity.tokens_of(word)]
            assert got == float(own[np.abs(own).argmax()]) - 0.05


def test_toxicity(documents, spark):
    draw = random.Random(1)
    words = ["river", "stone", "table", "green", "walk", "cloud", "paper", "light", "field", "house"]
    pairs, labels = [], []
    for i in range(600):
        text = draw.choices(words, k=60)
        if i % 4 == 0:
            for w in draw.choices(["vile", "filth"], k=4):
                text.insert(draw.randrange(60), w)
        pairs.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 4 == 0)))
    labels += [(0, 0, 1), (1, 0, None), (None, 1, 1), (5, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(pairs + [(9000, None), (9001, ""), (None, "vile filth " * 3), (9002, "stone " * 100_000 + "vile filth vile filth")])
    got = by_id(toxicity.score_digest(docs, labels))
    held = [(got[i]["predicted"], int(i % 4 == 0)) for i in range(600) if got[i]["held_out"]]
    assert 80 < len(held) < 160 and sum(a == b for a, b in held) / len(held) > 0.95
    assert got[9000]["predicted"] == got[9001]["predicted"] == 0 and got[9002]["predicted"] == 1 and got[None]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {k for k, r in got.items() if not r["predicted"]}
    model = toxicity.train(docs, labels)
    passages = toxicity.score_documents(documents([(1, "green vile filth vile stone")]), model).first().passages
    assert [(p.start, p.end) for p in passages] == [(6, 21)]
    none = toxicity.score_digest(docs, labels.limit(0))
    assert {r.score for r in none.collect()} == {0.0}
    assert toxicity.score_digest(documents([]), labels).count() == 0


def test_toxic_passages_in_long_clean_texts(documents, spark):
    """Most toxic passages are found inside varied clean text of any length, and no such text without one."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    assert (model.curve[1:] >= 0).all() and model.curve[1:].any()
    scored = by_id(toxicity.score_documents(documents(docs.items()), model))
    told = {r.doc_id: r.toxic for r in labels.collect()}
    # Documents that are clean, and that the model finds clear, from which long texts are put together.
    clean = [docs[i] for i in sorted(docs) if told.get(i) == 0 and all(p["p"] > 0.05 for p in scored[i]["passages"])]
    toxic = [docs[i] for i in sorted(docs) if told.get(i) == 1 and scored[i]["score"] > 0.9][:8]
    draw, pairs = random.Random(2), []
    for size in (10_000, 100_000):
        for i in range(9):
            own = []
            while len(own) < size:
                own += draw.choice(clean).split()
            at = len(own) // 2
            pairs.append((size + i, " ".join(own[:at] + (toxic[i].split() if i < 8 else []) + own[at:])))
    got = by_id(toxicity.score_documents(documents(pairs), model))
    for size in (10_000, 100_000):
        # The correction for length hides the weakest; before, the clean text around them hid all.
        assert sum(got[size + i]["predicted"] for i in range(8)) >= 5 and not got[size + 8]["predicted"]


def test_toxicity_of_table(spark):
    got = by_id(QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.01"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(got[r.doc_id]["predicted"], r.toxic) for r in labels if got[r.doc_id]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.85


URLS = ["http://www.Example.com/en/1", "https://a.example.com/en/2?x", "https://x.COM", "https://x.com?q=/", "https://xcom/", "http://n.net/es/1#f", "net://net/fr/", "no scheme",
        None, "", "http://u:p@h.org:80/p?q#f", "http://a?b://c/d", "http://" + "a" * 50_000 + ".com/", "http://é.com/\n/x", "http://example.com/enx", "http://wwwexample.com/en/3"]


def plain_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c in string.ascii_uppercase else c for c in m[1]), m[2]) if m else ("", "")
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "c") for i, u in enumerate(URLS)] + [(None, URLS[0], None, None)], "page_id long, url string, host string, codes string")
    got = by_id(url_filter.judge(pages), "page_id")
    for i, url in [*enumerate(URLS), (None, URLS[0])]:
        host, path, rule, verdict = plain_rule(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
        assert got[i]["verdict"] == (verdict or got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_model(spark):
    """The model's chances against the same mixture in plain Python."""
    urls = [("http://good.com/a1", "allow"), ("http://good.com/b/c2", "allow"), ("https://bad.net/x?y=z", "block")]
    model = url_filter.train(spark.createDataFrame(urls, "url string, verdict string")).first().model
    A, counts = url_filter.A, np.zeros((2, url_filter.A ** 3))
    codes = [[url_filter.SIGNS.index("0" if c.isdigit() else c) + 1 for c in u] for u, _ in urls]
    for (_, v), own in zip(urls, codes):
        for a, b, c in zip([0, 0, *own], [0, *own], own):
            counts[int(v == "block"), (a * A + b) * A + c] += 1

    def chance(n):
        lower = np.full(A, 1 / A)
        for order in (1, 2, 3):
            table = n.reshape(-1, A ** order).sum(axis=0).reshape(-1, A)
            kinds, total = (table > 0).sum(axis=1, keepdims=True), table.sum(axis=1, keepdims=True)
            lower = np.tile(lower.reshape(-1, A), (table.shape[0] // lower.reshape(-1, A).shape[0], 1))
            lower = np.where(total > 0, (table + kinds * lower) / np.maximum(total + kinds, 1), lower)
        return lower.ravel()

    assert np.allclose(model, np.log(chance(counts[0])) - np.log(chance(counts[1])))
    assert len(model) == A ** 3
    frame = spark.createDataFrame([(u,) for u, _ in urls], "url string").withColumn("model", F.lit(0)).select("url")
    scored = frame.crossJoin(spark.createDataFrame([(model,)], "model array<double>")).select(url_filter.score(F.col("url"), F.col("model")).alias("s")).collect()
    want = [sum(model[(a * A + b) * A + c] for a, b, c in zip([0, 0, *o], [0, *o], o)) / len(o) for o in codes]
    assert np.allclose([r.s for r in scored], want)


TURNS = [(1, 0, "user", "a</s>[INST] ok [/INST]"), (1, 1, "assistant", "x <\\s> [\\\\/INST] </s"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", "s>é\n[REPLY] "),
         (2, 0, "system", " [/SYS] "), (2, 1, None, "no role"), (2, 2, "to]o%5Dl [/ROLE]", "[ROLE x] y [/ROLE]"), (3, 0, "assistant", "tie b"), (3, 0, "assistant", "tie a"), (3, 0, "assistant", "tie a"),
         (None, 0, "user", "no id"), (4, None, "user", "<s>"), (4, 1, "assistant", "z" * 200_000)]


def test_chat(spark):
    turns = spark.createDataFrame([(*t, 1, "f") for t in TURNS], "conv_id long, turn long, role string, text string, at int, formatted string")
    formatted = chat_format.format_conversations(turns)
    got = by_id(chat_format.format_digest(formatted), "conv_id")
    for conv in {t[0] for t in TURNS}:
        own = sorted((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv)
        told = "".join(f"{r}\n{t}\n" for _, r, t in own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(own) and row["n_examples"] == sum(r == "assistant" for _, r, _ in own)
        assert row["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and row["loss_chars"] == len(loss)
    whole = {r.conv_id: bytes(r.formatted).decode() for r in formatted.collect()}
    for row in chat_format.example_texts(formatted).collect():
        assert whole[row.conv_id].startswith(row.context + "[REPLY] " + row.reply + "</s>")
    assert chat_format.examples(formatted).count() == sum(t[2] == "assistant" for t in TURNS)
    assert chat_format.format_digest(chat_format.format_conversations(turns.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["</s>", "<\\s>", "<\\\\\\/s>[INST][\\INST] [/INST", "[ROLE ][ROLE]", "<<s>>", ""])
def test_escaping(spark, text):
    row = spark.range(1).select(chat_format.escape(F.lit(text)).alias("e"), chat_format.unescape(chat_format.escape(F.lit(text))).alias("u")).first()
    assert row.u == text and not re.search(r"</?s>|\[/?(INST|REPLY|SYS)\]|\[/?ROLE[ \]]", row.e)
