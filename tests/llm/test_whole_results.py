"""Whole results where groups are large, pages are odd or documents are repeated."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sitewise.llm import embeddings, html, minhash, mixing, queries, toxicity
from sitewise.llm.common import content_key


def test_noisy_group_larger_than_a_leaf(spark):
    r = np.random.default_rng(11)
    centre = r.standard_normal(64) / 8
    vectors = np.vstack([centre + 0.0155 * r.standard_normal((500, 64)), r.standard_normal((200, 64)) / 8])
    rows = [(i, v.astype("float32").tolist(), 0) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {x["vec_id"]: x for x in embeddings.link(table, embeddings.Forest(leaf=64, block=128)).collect()}
    unit = np.array([x[1] for x in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.98
    assert {i: got[i]["n_links"] for i in got} == dict(enumerate((linked.sum(axis=1) - 1).tolist()))
    least = np.arange(len(rows))
    for _ in range(10):
        least = np.array([least[near].min() for near in linked])
    assert {i: got[i]["component_id"] for i in got} == dict(enumerate(least.tolist()))


def test_positions_against_plain_integral(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 60))) + f" {i}", [None, "a", "b", "c"][min(i % 7, 3)]) for i in range(120)]
    rows += [(200, None, "b"), (201, "", "empty"), (None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    keyed = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), content_key(F.col("doc_id"), F.col("text")).alias("k")).collect()
    got = {x["doc_id"]: x for x in queries.op4_mixing(spark, str(tmp_path)).collect()}

    grid = np.linspace(0, 1, 20_001)  # holds every knot, so trapezoids are exact
    for i, source in enumerate(["a", "b", "c", "empty", None]):
        weight = np.interp(grid, *zip(*mixing.SCHEDULES[i % 3], strict=True))
        demand = np.concatenate([[0.0], np.cumsum((weight[1:] + weight[:-1]) / 2) * (grid[1] - grid[0])])
        before, total = 0, sum(len(x["text"].split()) for x in keyed if x["source"] == source)
        for x in sorted((x for x in keyed if x["source"] == source), key=lambda x: x["k"]):
            size, g = len(x["text"].split()), got[x["doc_id"]]
            wanted = [min((n * total + before + size / 2) / g["target"], 1.0) for n in range(g["repeats"])]
            assert len(g["positions"]) == g["repeats"]
            assert np.allclose(g["positions"], np.interp(np.array(wanted) * demand[-1], demand, grid), atol=1e-6)
            before += size

    taken = corpus_pipeline.mixed_sources(spark, docs, str(tmp_path)).collect()
    assert taken == sorted(taken, key=lambda x: x["position"])
    want = sorted((p, str(x["doc_id"])) for x in got.values() for p in x["positions"])
    assert sorted((x["position"], str(x["doc_id"])) for x in taken) == want and len(want) > 60


def test_position_reaches_the_packed_pieces(spark):
    docs = spark.createDataFrame([(1, "one two", 0.25), (1, "one two", 0.75), (2, None, 0.5)], "doc_id long, text string, position double")
    got = corpus_pipeline.packed(spark, docs, "").collect()
    assert sorted((x["doc_id"], x["position"]) for x in got) == [(1, 0.25), (1, 0.75), (2, 0.5)]


def test_unseen_elements_hide_no_text_after_them(spark):
    a, b = "alpha " * 30, "omega " * 30
    pages = {
        f"<head><title>t</title><meta charset=utf-8><style>p{{}}</style><body><p>{a}</p></body>": a,
        f"<head><title>t</title><p>{a}</p>": a,
        f"<head><title>t</title><script>var x;</script></head><p>{a}</p>": a,
        f"<article><p>{a}</p><svg viewBox='0 0 1 1'/><p>{b}</p></article>": a + b,
        f"<article><p>{a}</p><math/><p>{b}</p><math><mi>x</mi></math></article>": a + b,
        f"<article><p>{a}</p><svg /><p>{b}</p><svg><text>x</text></svg></article>": a + b,
        f"<article><p>{a}</p><button><p>{b}</p></article>": a + b,
        f"<article><p>{a}</p><button>x</button><button-bar></button-bar><p>{b}</p></article>": a + b,
        f"<article><p>{a}</p></article><script>var text = '{b}'": a,
    }
    table = spark.createDataFrame([(i, "u", page) for i, page in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(table).collect()}
    assert got == {i: text.strip() for i, text in enumerate(pages.values())}


def test_a_strong_word_leaves_room_for_another(spark):
    r = np.random.default_rng(6)
    texts, labels = [], []
    for i in range(400):
        words = [f"w{x}" for x in r.integers(0, 300, 120)]
        bad = "vileness" if i % 5 == 0 else "nasty" if i % 10 == 1 else None
        if bad:
            words[5] = words[50] = words[90] = bad
        texts.append((i, " ".join(words)))
        labels.append((i, int(bad is not None)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, truth, toxicity.Voting(voters=2))
    assert len(model.terms) == 2 and any("nast" in t for t in model.terms) and any("vile" in t for t in model.terms)
    assert all(x["predicted"] == labels[x["doc_id"]][1] for x in toxicity.score(docs, model).collect())


def test_near_duplicate_stage_against_brute_force(spark):
    r = np.random.default_rng(12)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 500, 60)) for _ in range(20)]
    texts += [f"{t} tail" for t in texts[:6]] + [f"{t} " + "x y z " * 9 for t in texts[6:9]] + [texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    least = list(range(len(sets)))
    for _ in sets:
        for a, left in enumerate(sets):
            for b, right in enumerate(sets):
                if 10 * len(left & right) >= 8 * len(left | right):
                    least[a] = least[b] = min(least[a], least[b])
    got = {x["doc_id"] for x in corpus_pipeline.one_of_each_group(spark, docs, "").collect()}
    assert got == set(least) and len(got) < len(texts)


def test_sharding_query_balances_bytes(spark, tmp_path):
    rows = [(i, "é" * (i % 50)) for i in range(2000)]
    spark.createDataFrame([*rows, (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_sharding(spark, str(tmp_path)).collect()
    sizes = {x["doc_id"]: x["size"] for x in got}
    assert len(got) == 2001 and sizes == {None: 1} | {i: len(t.encode()) + 1 for i, t in rows}
    held = [sum(x["size"] for x in got if x["shard"] == k) for k in range(16)]
    assert max(held) - min(held) <= 2 * max(sizes.values())


def test_near_copies_of_one_text_that_are_far_from_each_other(spark, monkeypatch):
    """A base text, copies at all distances from it, and chains that hang on copies rather than on the base."""
    r = np.random.default_rng(3)
    base = [f"b{x}" for x in range(120)]

    def edited(words, n, tag):
        out = list(words)
        for i in r.choice(len(out), n, replace=False):
            out[i] = f"{tag}x{i}"
        return out

    texts = [edited(base, int(n), f"c{i}") for i, n in enumerate(r.integers(1, 16, 120))]
    texts += [base] + [edited(texts[i % 120], 2, f"d{i}") for i in range(60)]
    texts += [edited(texts[121 + i % 60], 2, f"e{i}") for i in range(40)]
    at = r.permutation(len(texts))
    docs = spark.createDataFrame([(int(i), " ".join(texts[k])) for i, k in enumerate(at)], "doc_id long, text string")
    monkeypatch.setattr(minhash, "MEMBERS", 16)
    rule = minhash.NearDup(words=3, percent=85, bands=64, rows=4)
    sets = [{tuple(texts[k][i : i + 3]) for i in range(len(texts[k]) - 2)} for k in at]
    least = list(range(len(sets)))
    for _ in range(len(sets)):
        before = list(least)
        for a, left in enumerate(sets):
            for b in range(a):
                if least[a] != least[b] and 100 * len(left & sets[b]) >= 85 * len(left | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(docs, rule).collect()}
    assert got == dict(enumerate(least))
    assert 3 < len(set(least)) < 120
