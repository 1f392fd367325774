"""Odd tables for every operator and stage: clashing columns, empty tables, repeats, and executors without the package."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitewise.llm import html, merkle, minhash, mixing, packing, phrases, quality, queries, rules, secrets, shards, tokens, toxicity
from sitewise.llm.common import content_key, n_words

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CLASHES = """kind key size source_size target taken repeats positions position shard slot kept n_words base_failed word_distance score predicted
    held_out _key _words _part _kind _row _keep _measured _tokens n_shingles component_id hub node tree pos block spans w1 c k phrase n piece length""".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(n=60):
    out = [(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(70)), ["en", "de", None][i % 3], ["a", None][i % 2], 3) for i in range(n)]
    out[7], out[8] = (*out[6][:2], "en", "a", 3), out[6]
    return out + [(None, None, None, None, None), (900, "", "", "", 0), (901, " \n", "fr", "b", 1)]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def labels(spark, n=60):
    return spark.createDataFrame([*[(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(n)], (None, 1, 1), (5, None, None), (6, 0, 0)], "doc_id long, quality int, toxic int")


def vocabulary(name="byte_bpe_50k.json"):
    return queries.tokenizer_file(name)


OPERATORS = {
    "rules": lambda s, d: rules.passing(d),
    "judge": lambda s, d: rules.judge(d),
    "near": lambda s, d: minhash.near_duplicates(d),
    "keep_one": lambda s, d: minhash.keep_one(d),
    "mix": lambda s, d: mixing.mix(d, n_words(F.col("text"))),
    "shards": lambda s, d: shards.histogram_shards(
        d.withColumn("bytes_", F.octet_length(F.coalesce("text", F.lit(""))) + 1), content_key(F.col("doc_id"), F.col("text")), F.col("bytes_"), 4
    ),
    "packing": lambda s, d: packing.pack_documents(d, vocabulary()),
    "tokens": lambda s, d: tokens.token_counts(d, tokens.Unigram.from_pieces(["▁w", "1", "2"])),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.learn(d, labels(s))),
    "quality": lambda s, d: quality.score(d, quality.learn(d, labels(s))),
    "manifest": lambda s, d: merkle.manifest(d, F.col("doc_id") % 2 == 0, F.lit("x")),
    "phrases": lambda s, d: phrases.collocations(d, phrases.Mining(least=3)),
    "secrets": lambda s, d: secrets.digest_columns(secrets.find_secrets(d, vocabulary("byte_bpe_50k.tiktoken"))),
    "stage mixing": lambda s, d: corpus_pipeline.mixed_sources(s, d, ""),
    "stage rules": lambda s, d: corpus_pipeline.quality_rules(s, d, ""),
    "stage dedup": lambda s, d: corpus_pipeline.one_of_each_group(s, d, ""),
}


def key(r):
    return [str(x) for x in r]


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, plain, name):
    make = OPERATORS[name]
    want = make(spark, plain)
    got = make(spark, plain.withColumns({c: F.lit("clash") for c in CLASHES}))
    columns = [c for c in want.columns if c in got.columns and c not in ("sequence_id", "offset")]
    assert set(want.columns) <= set(got.columns)
    assert sorted(map(key, got.select(columns).collect())) == sorted(map(key, want.select(columns).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_toxicity_stage(spark, tmp_path):
    docs = spark.createDataFrame([(i, ("vile nasty " * 4 if i % 4 == 0 else "") + " ".join(f"w{(i * j) % 83}" for j in range(1, 60))) for i in range(300)], "doc_id long, text string")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.clean_of_toxicity(spark, docs.withColumn("score", F.lit(1)), str(tmp_path)).collect()}
    assert left == {i for i in range(300) if i % 4}


def test_names_of_whole_pages_hide_no_article(spark):
    text = "A plain sentence about a quiet day at the lake, told at some length. " * 6
    pages = [
        f"<main class='search-page'><p>{text}</p></main>", f"<article class='promo-article'><p>{text}</p></article>", f"<body class='has-nav'><p>{text}</p></body>",
        f"<div class='login-page'><p>{text}</p></div>", f"<div class='discussion-page'><main><p>{text}</p></main></div>",
        f"<p>{text}</p><p>She baked cookies for the children, who ate all of them at once and asked for more.</p>",
    ]
    docs = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(docs).collect()}
    assert all(got[i] == text.strip() for i in range(5))
    assert got[5].endswith("asked for more.")
    hidden = f"<article><p>{text}</p><section class='comments'><article class='comment'><p>I do not agree with any of it at all.</p></article></section></article>"
    hidden += "<div class='cookie-banner'><p>We use cookies to make this site work.</p></div>"
    assert html.extract(docs.limit(1).withColumn("html", F.lit(hidden))).first()["text"] == text.strip()


def test_executors_need_no_copy_of_the_package(tmp_path):
    """Workers start in another folder, where `sitewise` can't be imported; only the driver's own path has it."""
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import SparkSession, functions as F
        spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("OFF")

        def importable(batches):
            import importlib.util
            import pyarrow as pa
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("sitewise") is not None])], ["x"])

        assert not any(r[0] for r in spark.range(1).mapInArrow(importable, "x boolean").collect())
        import __spark_entry__ as entry
        for name in [q for q in entry.queries() if q.startswith("op") or q == "pipeline"]:
            entry.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
            print("ran", name, flush=True)
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stdout[-500:] + out.stderr[-3000:]
    assert out.stdout.count("ran ") == 14
