"""The pipeline operators against plain versions, on small fixtures with nulls, empties, ties and repeats."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.llm import embeddings, html, minhash, mixing, packing, quality, rules, shards, tokens, toxicity
from sitewise.llm.common import content_key, n_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/x'>Home</a></li></ul></nav>"
    "<div class='ad'>Buy now and save a lot of money today.</div><article><h1>A &amp; B</h1><p><b>First\n part<br><p>Gr&uuml;n &#33;</p>"
    "<div class='comments'><p>I disagree with all of this, dear author.</p></div></article>"
    "<script>var t='</p>';</script><footer>&copy; me</footer></body></html>"
)


def random_texts(n, seed=3, words=40):
    r = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in r.integers(0, 500, words)) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = random_texts(30)
    texts += [texts[0], texts[1] + " tail", None, "", "  \n ", "one two", "ONE two", texts[2] * 40]
    rows = [(i, t, "en" if i % 3 else None, [None, "a", "b", "c"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, None, None, None, None)], SCHEMA)


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, None, "<p>" + "word " * 30)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(pages).collect()}
    assert got[1] == ("A & B First part Grün !", 23)
    assert got[2] == got[3] == ("", 0)
    assert got[None][0] == " ".join(["word"] * 30)
    assert html.extract(pages.limit(0)).count() == 0


def brute_components(sets, linked):
    least = {k: k for k in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if linked(sets[a], sets[b]):
                least[a] = least[b] = min(least[a], least[b])
    return least


def test_minhash(docs):
    rule = minhash.NearDup(words=3, percent=85)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, rule).collect()}

    def shingles(text):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect() if r["doc_id"] is not None}
    want = brute_components(sets, lambda a, b: bool(a & b) and 100 * len(a & b) >= 85 * len(a | b))
    assert {k: got[k]["component_id"] for k in want} == want
    assert {k: got[k]["n_shingles"] for k in sets} == {k: len(s) for k, s in sets.items()}
    assert minhash.keep_one(docs, rule).count() == len(set(want.values())) + 1


def test_rules(docs):
    got = {r["doc_id"]: r for r in rules.judge(docs, rules.language_references(docs)).collect()}
    for r in docs.where("doc_id is not null").collect():
        text = r["text"] or ""
        w = text.split()
        seen = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        again = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_repeat_words"]) == (len(w), sum(map(len, w)), len(again))
        assert g["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
    assert rules.passing(docs, {}).columns == docs.columns
    assert rules.judge(docs.limit(0), {}).count() == 0


def test_mixing(docs):
    rows = mixing.mix(docs, n_words(F.col("text"))).collect()
    taken, targets, longest = {}, {}, {}
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        targets[r["source"]] = r["target"]
        longest[r["source"]] = max(longest.get(r["source"], 0), r["size"])
        assert r["taken"] <= 3 * r["size"] and len(r["positions"]) == r["repeats"]
    assert len(rows) == docs.count()
    assert abs(sum(targets.values()) - sum(r["size"] for r in rows)) < 1e-6
    assert all(abs(taken[s] - targets[s]) <= longest[s] for s in taken)


def test_shards(docs):
    sized = docs.withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1)
    rows = shards.histogram_shards(sized, content_key(F.col("doc_id"), F.col("text")), F.col("size"), 4, order=("doc_id",)).collect()
    assert len(rows) == docs.count()
    for k in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))


@pytest.mark.parametrize("counts", [{2048: 3, 1024: 1}, {1000: 1, 48: 1, 2000: 1}, {700: 1, 648: 1, 2: 5}, {1: 1}, {}])
def test_plan(counts):
    used = {}
    for pattern, times in packing.plan_patterns(counts):
        assert sum(pattern) <= 2048 and times > 0
        for x in pattern:
            used[x] = used.get(x, 0) + times
    assert used == counts


def test_packing_ids(docs):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = str(public.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, path, with_ids=True).collect()
    reference = tokenizers.Tokenizer.from_file(path)
    for r in docs.where("doc_id is not null").collect():
        ids = [x for p in sorted((p for p in rows if p["doc_id"] == r["doc_id"]), key=lambda p: p["piece"]) for x in p["ids"]]
        assert ids == [*reference.encode(r["text"] or "", add_special_tokens=False).ids, 0]
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_tokens(spark):
    model = tokens.Unigram.from_pieces(["▁", "▁the", "▁th", "e", "t", "h", "the", "re"])

    def plain(token):
        best = [(0.0, 0)]
        for end in range(1, len(token) + 1):
            single = len(token[end - 1].encode())
            options = [(best[end - 1][0] + model.unknown * single, best[end - 1][1] + single)]
            options += [(best[s][0] + model.scores[token[s:end]], best[s][1] + 1) for s in range(end) if token[s:end] in model.scores]
            best.append(max(options, key=lambda o: o[0]))
        return best[-1][1]

    texts = ["the there theé the", None, "", " \n", "t" * 200 + " the"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in tokens.token_counts(rows, model).collect()}
    assert got == {i: (len((t or "").split()), sum(plain("▁" + w) for w in (t or "").split())) for i, t in enumerate(texts)}


def test_embeddings(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((300, 16))
    base[200:260] = base[:60] + 0.02 * r.standard_normal((60, 16))
    base[260:] = base[7]
    rows = [(i, v.astype("float32").tolist(), int(i % 2 if i < 200 else (i - 200) % 2 if i < 260 else 1)) for i, v in enumerate(base)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, [], 1), (905, [None] * 16, 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {x["vec_id"]: x for x in embeddings.link(table, embeddings.Forest(leaf=32, trees=8)).collect()}
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, _ in rows}
    label = {i: y for i, _, y in rows}
    links = {i: 0 for i in unit}
    for a, b in itertools.combinations(unit, 2):
        if label[a] == label[b] and unit[a] @ unit[b] >= 0.98:
            links[a] += 1
            links[b] += 1
    assert {i: got[i]["n_links"] for i in unit} == links
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _, _ in odd)
    assert all(got[i]["component_id"] == 7 for i in range(260, 300))


def test_classifiers(spark):
    r = np.random.default_rng(8)
    texts, labels = [], []
    for i in range(400):
        good, toxic = int(r.random() < 0.6), int(r.random() < 0.3)
        words = [f"{'abcde'[x % 5]}{x}" for x in r.integers(0, 300, 120)] if good else [f"{x}###" for x in r.integers(0, 40, 120)]
        if toxic:
            words[5] = words[50] = words[90] = ("vile", "nasty")[i % 2]
        texts.append((i, " ".join(words)))
        labels.append((i, good, toxic))
    texts += [(1000, None), (1001, ""), (None, "vile")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for module, column in ((toxicity, 2), (quality, 1)):
        rows = module.score(docs, module.learn(docs, truth)).collect()
        assert len(rows) == len(texts) and all(0 <= x["score"] <= 1 for x in rows)
        tested = [x for x in rows if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 400]
        assert sum(x["predicted"] == labels[x["doc_id"]][column] for x in tested) >= 0.95 * len(tested)
        flat = module.score(docs, module.learn(docs, truth.limit(0))).collect()
        assert len(flat) == len(texts)
        assert module.score(docs.limit(0), module.learn(docs, truth)).count() == 0
