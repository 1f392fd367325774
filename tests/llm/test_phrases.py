"""Collocations against plain counts of all n-grams."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.llm import phrases, queries


def plain(rows, least, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q[i:j] for q, b in often.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) and b >= often[q[i:j]]}
        scored = []
        for p, a in often.items():
            if p in gone:
                continue
            s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def texts(n, seed, vocabulary):
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Ärger", "THE", "the", "x y", "it's"]
    p = 1 / np.arange(1, len(words) + 1)
    marks = np.array([" "] * 8 + [". ", "\n", "\t", " ; "])
    out = []
    for i in range(n):
        body = "".join(w + m for w, m in zip(r.choice(words, 80, p=p / p.sum()), r.choice(marks, 80), strict=True))
        out.append((["en", "de", None, "und", ""][i % 5], body + "New York City Hall of fame " * (i % 4)))
    return out


@pytest.mark.parametrize("bits", [8, 16, 24])
def test_against_plain_counts(spark, bits, monkeypatch):
    rows = texts(120, 1, 40) + [("en", None), ("en", ""), (None, " \t\n"), ("fr", "one"), ("en", "deep sea " * 20_000)]
    rule = phrases.Mining(least=20, top=30, bits=max(bits, 16))
    if bits == 8:
        monkeypatch.setattr(phrases, "ENOUGH", 500)
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "lang string, text string, w1 string").repartition(5)
    got = phrases.collocations(docs, rule)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, 20, 30)
    assert len(want) > 40
    assert sorted(map(tuple, got.collect())) == want


def test_query_over_a_table(spark, tmp_path):
    rows = texts(150, 2, 5)
    spark.createDataFrame(rows, "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_phrase_collocations(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == plain(rows, 100, 2000) and got


def test_windows_are_sent_once_per_core(spark):
    rows = [("en", f"deep sea {'abcdefgh'[i % 8]} old town") for i in range(400)]
    docs = phrases._together(spark.createDataFrame(rows, "lang string, text string").repartition(50))
    often = np.full((3, 1 << 13), 255, np.uint8)
    got = phrases._windows(docs, often, phrases.Mining(least=1, bits=16))
    # 26 distinct windows: 8 letters in 3 places of a window, and the two without a letter.
    assert got.distinct().count() >= 26 and got.count() <= 26 * spark.sparkContext.defaultParallelism
    assert got.agg(F.sum("c")).first()[0] == 5 * 400


def test_windows_outlive_forgotten_words(spark, monkeypatch):
    monkeypatch.setattr(phrases, "ENOUGH", 50)
    monkeypatch.setattr(phrases, "KNOWN", 4)
    rows = [("en", "deep sea old town"), ("de", "tief im Tal")] * 100
    got = phrases._windows(spark.createDataFrame(rows, "lang string, text string").coalesce(1), np.full((3, 1 << 13), 255, np.uint8), phrases.Mining(least=1, bits=16))
    assert sorted((r.lang, r.w1, r.w2, r.c) for r in got.collect()) == [
        ("de", "im", "tal", 100), ("de", "tal", "", 100), ("de", "tief", "im", 100),
        ("en", "deep", "sea", 100), ("en", "old", "town", 100), ("en", "sea", "old", 100), ("en", "town", "", 100),
    ]


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_products_beyond_64_bits(spark):
    big = 1 << 40
    rows = spark.createDataFrame([(big + 1, big + 3, big, big + 7)], "a long, l long, r long, n long")
    got = rows.select(phrases.score(F.col("a"), F.col("l"), F.col("r"), F.col("n")).alias("s")).first()["s"]
    assert got == 1000 * (big + 1) * (big + 7) // ((big + 3) * big)
