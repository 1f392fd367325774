"""Plans and results that must hold on tables larger than the smallest ones."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sitewise.functions.geometry import MULTI
from sitewise.operators import polygon, registration, search
from sitewise.session import spread

SF_DIR = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_union_sends_no_table_to_the_driver(spark):
    assert "BroadcastExchange" not in _plan(entry.queries()["polygon_union"](spark, SF_DIR))


@pytest.mark.parametrize("name", ["tile_grids", "search_windows", "grid_tiles"])
def test_grids_of_one_small_file_run_in_many_tasks(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert df.rdd.getNumPartitions() > 1


def test_exact_search_grows_with_the_queries(spark):
    places = spark.createDataFrame([(k, "Oak" if k < 90 else "Elm") for k in range(100)], "row_id long, name_lc string")
    places = places.withColumn("name_lc", F.lower("name_lc"))
    queries = spark.createDataFrame([(q, "Oak Village" if q % 2 else "ELM") for q in range(20)], "query_id long, query string")
    found = search.exact_matches(queries, places)
    rows = {(r.query_id, r.class_id, r.n_links) for r in found.collect()}
    assert rows == {(q, 0, 90) if q % 2 else (q, 90, 10) for q in range(20)} and found.count() == 20
    # Membership gives back every pair of a query and a place.
    assert found.join(search.name_classes(places), "class_id").count() == 10 * 90 + 10 * 10


def test_exact_search_gives_every_pair_in_tasks_that_grow_with_them(spark, monkeypatch):
    whole = entry.queries()["search_exact"](spark, SF_DIR)
    links = entry.queries()["search_exact_classes"](spark, SF_DIR).agg(F.sum("n_links")).first()[0]
    assert sorted(whole.columns) == ["cand_pos", "query_id", "row_id"] and whole.count() == links > 0
    monkeypatch.setattr(search, "NAME_BLOCK", 7)
    monkeypatch.setattr(search, "TASK_PAIRS", 100)
    names, texts = ["oak", "oak", "elm", "oak village", "ash"], ["Oak Village", "ELM", "oak", " ", None, "yew"]
    spots = [(None if k == 50 else k, names[k % 5]) for k in range(100)] + [(0, "oak"), (1, None)]
    asked = [(q, texts[q % 6]) for q in range(60)] + [(0, "Oak Village")]
    places = spark.createDataFrame(spots, "row_id long, name_lc string")
    found = search.exact_pairs(spark.createDataFrame(asked, "query_id long, query string"), places)
    tried = {"Oak Village": ["oak village", "oak"], "ELM": ["elm"], "oak": ["oak"], "yew": ["yew"]}
    want = [(q, n, r) for q, t in asked for n, c in enumerate(tried.get(t, [])) for r, name in spots if name == c]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert found.rdd.getNumPartitions() == -(-len(want) // 100) > 8
    assert search.exact_pairs(spark.createDataFrame([], "query_id long, query string"), places).count() == 0


def test_a_question_that_many_ask_is_answered_once(spark):
    places = spark.createDataFrame(
        [(k, n, 1000.0 * k, 0.0, d, None, None) for k, (n, d) in enumerate([("Oak Hill", "North"), ("Oak Hill", "South"), ("Oakham", "North"), ("Weybourne", "South")])],
        "row_id long, name1 string, easting double, northing double, district_borough string, county_unitary string, populated_place string",
    )
    texts = [("oak", None), ("oak", "South"), ("weyborne", None), ("weyborne", "Nowhere"), (" ", None), (None, "North"), ("oak", "")]
    queries = spark.createDataFrame([(q, *texts[q % 7]) for q in range(70)], "query_id long, query string, context string")
    asked = search.questions(queries)
    assert sorted(r.query_id for r in asked.collect()) == [0, 1, 2, 3, 6]
    one_by_one = search.answers(queries, places, k=3)
    together = search.search(queries, places, k=3)
    assert together.columns == one_by_one.columns
    assert sorted(map(tuple, together.collect()), key=str) == sorted(map(tuple, one_by_one.collect()), key=str) and together.count() > 70


def test_runs_merge_in_one_shuffle_and_one_sort(spark):
    plan = _plan(entry.queries()["merged_runs"](spark, SF_DIR))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_tasks_grow_with_the_rows(spark):
    assert spread(spark.range(1000), "id", rows_per_task=20).rdd.getNumPartitions() == 50
    assert spread(spark.range(0), "id", rows_per_task=20).rdd.getNumPartitions() == 8


@pytest.mark.parametrize("name, shuffles", [("outline_fill", 1), ("mask_outlines", 3)])
def test_masks_are_shuffled_before_they_are_drawn(spark, name, shuffles):
    plan = _plan(entry.queries()[name](spark, SF_DIR))
    # The one more of mask_outlines and outline_fill deals finished shapes.
    assert "Broadcast" not in plan and plan.count("REPARTITION_BY_NUM") == shuffles and plan.count("Exchange") == shuffles + 1


def test_area_and_centroid_in_one_pass_equal_both(spark):
    shapes = ["[[[{0,0},{4,0},{4,3},{0,0}],[{2,0.5},{3,0.5},{3,1},{2,0.5}]]]", "[[[{1,1},{2,2},{3,3},{1,1}]]]", "null"]
    texts = [re.sub(r"\{([\d.]+),([\d.]+)\}", r'{"x":\1,"y":\2}', t) for t in shapes]
    g = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", F.from_json("t", MULTI).alias("g"))
    both = g.select("k", polygon.area_centroid(F.col("g")).alias("b"), polygon.area(F.col("g")).alias("a"), polygon.centroid(F.col("g")).alias("c"))
    rows = both.orderBy("k").collect()
    assert rows[0].a == 5.75 and (rows[0].b.area, rows[0].b.c) == (rows[0].a, rows[0].c) and rows[1].b.c == rows[1].c
    assert [(r.b.area if r.b else None) for r in rows] == [r.a for r in rows]


def test_overlay_sends_no_table_to_the_driver(spark):
    assert "BroadcastExchange" not in _plan(entry.queries()["polygon_overlay"](spark, SF_DIR))


@pytest.mark.parametrize("name", ["similarity_fit", "similarity_fit_shares"])
def test_fits_of_small_matches_join_no_points_with_models(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_DIR))
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("MapInArrow") == 1 and "HashAggregate" not in plan
    # similarity_fit_shares joins its points with their vectors.
    assert plan.count("Join") == (name == "similarity_fit_shares")


def test_tasks_of_a_fit_grow_with_its_points(spark, monkeypatch):
    monkeypatch.setattr(registration, "TASK_POINTS", 100, raising=False)
    points = spark.range(3200).selectExpr("id div 32 AS match_id", "id % 32 AS idx", *[f"cast(id * {k} % 97 AS double) AS {c}" for k, c in zip((3, 5, 3, 5), ("x0", "y0", "x1", "y1"))])
    fits = registration.fit_similarity(points)
    assert fits.rdd.getNumPartitions() == 32 and fits.count() == 100


def _alike_points(spark, n, each):
    columns = [f"cast(id * {k} % 97 AS double) AS {c}" for k, c in zip((3, 5, 3, 5), ("x0", "y0", "x1", "y1"))]
    return spark.range(n).selectExpr(f"id div {each} AS match_id", f"id % {each} AS idx", *columns)


def test_points_of_matches_too_small_to_fit_ask_for_tasks_too(spark, monkeypatch):
    monkeypatch.setattr(registration, "TASK_POINTS", 100)
    fits = registration.fit_similarity(_alike_points(spark, 3200, 2).unionByName(_alike_points(spark, 320, 32)))
    # Both have matches 0 to 9, which so have 34 points.
    assert fits.rdd.getNumPartitions() == 36 and {(r.match_id, r.n_points) for r in fits.collect()} == {(m, 34) for m in range(10)}


def test_tasks_of_large_matches_grow_with_their_points(spark, monkeypatch):
    points, dealt, rank = _alike_points(spark, 3200, 32), [], registration.bucketed_rank
    whole = {r.match_id: r.asDict() for r in registration.fit_similarity(points).collect()}
    monkeypatch.setattr(registration, "TASK_POINTS", 100)
    monkeypatch.setattr(registration, "PART", 20)
    monkeypatch.setattr(registration, "bucketed_rank", lambda df, *args: dealt.append(df.rdd.getNumPartitions()) or rank(df, *args))
    parts = {r.match_id: r.asDict() for r in registration.fit_similarity(points).collect()}
    assert dealt == [32] and len(parts) == 100
    assert parts == {k: {c: pytest.approx(x, rel=1e-9, abs=1e-6) if isinstance(x, float) else x for c, x in v.items()} for k, v in whole.items()}


def test_whole_matches_fit_like_parts(spark, monkeypatch):
    rng, rows = random.Random(4), [(None, i, 1.0 * i, 2.0, 3.0, 4.0) for i in range(9)]
    sizes = [3, 4, 5, 12, 12, 40, 64, 65, 100, 100, 150]
    for m, n in enumerate(sizes):
        for i in range(n):
            x, y = rng.uniform(0, 500), rng.uniform(0, 500)
            moved = rng.uniform(-900, 900) if i % 3 == 1 else rng.gauss(0, 1)
            rows.append((f"m{m}", i, x, None if i == 8 else y, 1.2 * x - 0.5 * y + moved, 0.5 * x + 1.2 * y + 2 * moved))
    rows += [("same", i, 1.0, 1.0, 2.0, 2.0) for i in range(6)] + [("flat", i, 1.0 * i, 1.0, 2.0, 2.0) for i in range(6)]
    points = spark.createDataFrame(rows, "match_id string, idx int, x0 double, y0 double, x1 double, y1 double").repartition(3)

    def fits():
        return {r.match_id: r.asDict() for r in registration.fit_similarity(points).collect()}

    whole = fits()
    assert set(whole) == {f"m{m}" for m, n in enumerate(sizes) if n > 3} and all(whole[f"m{m}"]["n_points"] == sizes[m] for m in range(1, len(sizes)))
    for part in (2, 50):  # all matches in parts, then the larger ones
        monkeypatch.setattr(registration, "PART", part)
        assert fits() == {k: {c: pytest.approx(x, rel=1e-9, abs=1e-6) if isinstance(x, float) else x for c, x in v.items()} for k, v in whole.items()}


def test_whole_matches_draw_the_models_of_parts(spark):
    rows = spark.range(3).select(F.concat(F.lit("m"), "id").alias("match_id"), F.xxhash64(F.lit(7), F.concat(F.lit("m"), "id")).alias("key"))
    n, models = 70, range(5, 30)
    drawn = rows.withColumn("model", F.explode(F.sequence(F.lit(5), F.lit(29)).cast("array<bigint>")))
    p, q = registration._pair(F.lit(n).cast("bigint"), F.lit(n * (n - 1) // 2).cast("bigint"), F.col("model"), 7, 2000)
    want = {(r.match_id, r.model): (r.p, r.q) for r in drawn.select("match_id", "model", p.alias("p"), q.alias("q")).collect()}
    keys = {r.match_id: r.key for r in rows.collect()}
    first, second = registration._draws(np.array(list(keys.values())), models, n)
    assert want == {(k, m): (first[i, j], second[i, j]) for i, k in enumerate(keys) for j, m in enumerate(models)}
