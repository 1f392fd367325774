import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewise.evaluate import scores as sc
from sitewise.functions.fuzzy import weighted_ratio
from sitewise.operators import ranking, registration, roads, search, stats
from sitewise.prep import folds, incremental


def test_medians_are_exact(spark):
    rng = random.Random(5)
    values = [(k, rng.choice([rng.random(), 0.25])) for k in range(3) for _ in range(rng.choice([1001, 40_000]))]
    got = {r.k: r for r in stats.value_summary(spark.createDataFrame(values, "k int, v double"), ["k"], "v").collect()}
    for k in range(3):
        own = sorted(v for q, v in values if q == k)
        n = len(own)
        assert got[k].median == (own[(n - 1) // 2] + own[n // 2]) / 2 and got[k].upper_median == own[n // 2]


def _middle(values):
    own = sorted(values)
    return (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2, own[len(own) // 2]


def test_medians_of_many_values_in_one_plan(spark):
    rng = random.Random(8)
    rows = [
        (rng.choice([None, 1, 1, 1]), rng.lognormvariate(0, 40), rng.choice([None, rng.random(), math.inf]),
         rng.choice([1e300, -1e300, 1.0 + rng.randint(0, 3) * 2.0**-52]))
        for _ in range(30_000)
    ]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double")
    values = {"a": F.col("a"), "b": F.col("b"), "c": F.col("c"), "none": F.lit(None).cast("double")}
    for rounds in (1, 3):
        got = {r.k: r for r in stats.value_summaries(df, ["k"], values, [F.count("*").alias("rows")], rounds).collect()}
        assert set(got) == {None, 1}
        for k, line in got.items():
            own = [r for r in rows if r[0] == k]
            assert line.rows == len(own) and line.none_n == 0 and line.none_median is None
            for i, name in enumerate("abc", start=1):
                present = [r[i] for r in own if r[i] is not None]
                assert line[f"{name}_n"] == len(present)
                assert (line[f"{name}_median"], line[f"{name}_upper_median"]) == _middle(present)
    whole = stats.value_summaries(df, [], values).collect()[0]
    assert (whole.a_median, whole.a_upper_median) == _middle([r[1] for r in rows])


def test_summaries_of_few_and_no_rows(spark):
    two = spark.createDataFrame([(1.0,), (4.0,)], "v double")
    line = stats.value_summary(two, [], "v").collect()[0]
    assert (line.n, line.median, line.upper_median, line.min, line.max) == (2, 2.5, 4.0, 1.0, 4.0)
    empty = two.where("v > 9")
    line = stats.value_summary(empty, [], "v").collect()[0]
    assert line.n == 0 and line.median is None
    assert stats.value_summary(empty.withColumn("k", F.lit(1)), ["k"], "v").collect() == []


def test_windows_run_over_parts_or_inside_one(spark):
    df = spark.range(400_000).select((F.rand(3) * 1e6).alias("v"))
    plan = stats.value_summaries(df, [], {"v": F.col("v"), "w": -F.col("v")})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    # by part: at most PARTS + 2 rows a value; by value: only inside a cell
    assert windows and all("[_part#" in line or "_cell#" in line.split("], [")[-2] for line in windows)


def test_two_level_rank_and_running_totals(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, seq int, v int")
    ranked = stats.bucketed_rank(df, ["k"], [F.col("seq")], F.floor(F.col("seq") / 100)).collect()
    total = {r.seq: r.t for r in stats.running_totals(df, ["k"], "seq", {"t": F.col("v")}, step=64).collect()}
    for k in (0, 1):
        own = [r for r in rows if r[0] == k]
        assert [r.rank for r in sorted((r for r in ranked if r.k == k), key=lambda r: r.seq)] == list(range(1, len(own) + 1))
        running = 0
        for _, seq, v in own:
            running += v
            assert total[seq] == running


def test_auc_of_the_sample_errors(spark):
    errors = [4.3644, 3.2340, 4.4359, 1.3157, 2.9037, 2.9106, 3.6509, 0.0317, 1.8696, 3.6857]
    got = {r.threshold: r.auc for r in sc.error_auc(spark.createDataFrame([(e,) for e in errors], "e double"), [], "e", [1, 3, 5]).collect()}

    def plain(t):
        xs, n = [0.0, *sorted(errors)], len(errors)
        ys = [i / n for i in range(n + 1)]
        last = sum(x < t for x in xs)
        xs, ys = [*xs[:last], t], [*ys[:last], ys[last - 1]]
        return sum((x2 - x1) * (y1 + y2) / 2 for x1, x2, y1, y2 in zip(xs, xs[1:], ys, ys[1:])) / t

    assert got == pytest.approx({float(t): plain(t) for t in (1, 3, 5)})


@pytest.mark.parametrize("seed", range(4))
def test_folds_equal_the_plain_greedy(spark, seed):
    rng = random.Random(seed)
    sizes = {f"g{rng.randint(0, 10**6)}": rng.choice([1, 1, 1, 2, 3, 7, 40]) for _ in range(rng.randint(3, 120))}
    cases = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "group_key string")
    loads, expected = [0] * 5, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        f = min(range(5), key=lambda f: (loads[f], f))
        expected[g], loads[f] = f, loads[f] + sizes[g]
    assert {r.group_key: r.fold for r in folds.balanced_folds(cases).collect()} == expected


def places_frame(spark, names):
    rows = [(i, n, "d", "c", None, 1000.0 * i, 0.0) for i, n in enumerate(names)]
    return spark.createDataFrame(
        rows, "row_id int, name1 string, district_borough string, county_unitary string, populated_place string, easting double, northing double"
    )


def test_fuzzy_names_match_all_pairs(spark):
    rng = random.Random(11)
    words = ["manor", "road", "east", "langdon", "weybourne", "st", "mary", "a", "hill", "green", "upper", "x"]
    names = sorted({" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(80)})
    asked = ["manour road", "langdn", "maryy st", "uper green", "b", "a", "weyborne hil", "xx", "hillgreen", "road st a"]
    cands = spark.createDataFrame([(i, None, 0, q) for i, q in enumerate(asked)], "query_id int, context string, cand_pos int, cand string")
    table = spark.createDataFrame([(n, None, i) for i, n in enumerate(names)], "name_lc string, context string, pos int")
    got = {(r.query_id, r.name_lc) for r in search.fuzzy_names(cands, table, 1000).collect()}
    assert got == {(i, n) for i, q in enumerate(asked) for n in names if weighted_ratio(q, n) >= 85}


def edits(rng, text):
    """text with a few letters dropped, doubled or changed, or tokens swapped, repeated or cut off."""
    out = list(text)
    for _ in range(rng.randint(0, 3)):
        i = rng.randrange(len(out)) if out else 0
        out[i : i + 1] = rng.choice([[], out[i : i + 1] * 2, [rng.choice("abcdexyz ")]])
    words = "".join(out).split()
    rng.shuffle(words)
    return rng.choice(["".join(out), " ".join(words), " ".join(words + words[:1]), "".join(out)[: rng.randint(1, 9)], f"{text} {rng.choice(['a', 'by the sea', 'x'])}"])


def test_no_alike_pair_is_lost_and_few_are_scored(spark):
    shares = []
    for size in (60, 400):
        rng = random.Random(size)
        token = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(2, 9)))
        names = sorted({" ".join(token() for _ in range(rng.randint(1, 3))) for _ in range(size)})
        asked = sorted({edits(rng, rng.choice(names)) for _ in range(size)} | {"", " ", "a", "ab", "aa aa", names[0], names[1].upper()})
        frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "text string")
        got = {(r.cand, r.name_lc) for r in search.fuzzy_candidates(frame(asked), frame(names)).collect()}
        assert {(q, n) for q in asked for n in names if weighted_ratio(q, n) >= 85} <= got
        shares.append(len(got) / (len(asked) * len(names)))
    assert shares[1] < 0.02


def test_search_falls_back_in_order(spark):
    places = places_frame(spark, ["East Langdon", "East Langdon", "Eastry", "Weybourne"])
    queries = spark.createDataFrame(
        [(1, "East Langdon village", None), (2, "weyborne", "Nowhere"), (3, "east", "d"), (4, "zzzzqq", None), (5, "Weybourne", "xyz,ddd")],
        "query_id int, query string, context string",
    )
    hits = {}
    for r in search.search(queries, places, k=3).collect():
        hits.setdefault(r.query_id, {})[r.hit] = r.row_id
    assert hits == {1: {1: 0, 2: 1}, 2: {1: 3}, 3: {1: 0, 2: 1, 3: 2}, 5: {1: 3}}


def test_similarity_fit_recovers_a_transform(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        x, y = rng.uniform(0, 500), rng.uniform(0, 500)
        if i % 3:
            rows.append(("m", i, x, y, 1.2 * x - 0.5 * y + 10, 0.5 * x + 1.2 * y - 20))
        else:
            rows.append(("m", i, x, y, rng.uniform(0, 900), rng.uniform(0, 900)))
    rows += [("few", i, 0.0, 0.0, 1.0, 1.0) for i in range(3)]
    fits = registration.fit_similarity(spark.createDataFrame(rows, "match_id string, idx int, x0 double, y0 double, x1 double, y1 double")).collect()
    assert len(fits) == 1 and fits[0].n_inliers >= 40
    assert [fits[0].a00, fits[0].a10] == pytest.approx([1.2, 0.5], abs=0.02)


@pytest.mark.parametrize(("inliers", "total"), [(15, 300), (30, 300), (15, 100), (6, 12), (5, 8)])
def test_similarity_fit_finds_few_inliers(spark, inliers, total):
    rng, rows, truth = random.Random(total + inliers), [], {}
    for m in range(200):
        scale, turn, tx, ty = rng.uniform(0.5, 2), rng.uniform(-3, 3), rng.uniform(-200, 200), rng.uniform(-200, 200)
        a, b = scale * math.cos(turn), scale * math.sin(turn)
        truth[m] = (a, b, tx, ty)
        for i in range(total):
            x, y = rng.uniform(0, 1000), rng.uniform(0, 1000)
            if i < inliers:
                rows.append((m, i, x, y, a * x - b * y + tx + rng.gauss(0, 1), b * x + a * y + ty + rng.gauss(0, 1)))
            else:
                rows.append((m, i, x, y, rng.uniform(-1000, 2000), rng.uniform(-1000, 2000)))
    frame = pd.DataFrame(rows, columns=["match_id", "idx", "x0", "y0", "x1", "y1"])
    found = 0
    for r in registration.fit_similarity(spark.createDataFrame(frame)).collect():
        a, b, tx, ty = truth[r.match_id]
        dx, dy = r.a00 * 500 + r.a01 * 500 + r.a02, r.a10 * 500 + r.a11 * 500 + r.a12
        found += math.hypot(dx - (a * 500 - b * 500 + tx), dy - (b * 500 + a * 500 + ty)) < 10
    assert found >= 195


def test_consensus_marks_both_ends(spark):
    rows = [(1, 1, "area", 52.0, 0.0), (1, 2, "road", 52.0040, 0.0), (1, 3, "postcode", 53.0, 0.0), (2, 4, "place", 52.0, 0.0)]
    got = {r.case_id: r for r in ranking.consensus(spark.createDataFrame(rows, "case_id int, seq int, source string, lat double, lon double")).collect()}
    assert (got[1].consensus, got[1].lat, got[1].sigma_m) == (True, 52.0040, 200)
    assert (got[2].consensus, got[2].sigma_m, got[2].confidence) == (False, 800, "med")


def test_road_overlap(spark):
    asked = spark.createDataFrame([(1, ["Manor Rd", "Manour Road", "Elm Close"]), (2, []), (3, ["Oak Lane"])], "request_id int, names array<string>")
    near = spark.createDataFrame([(1, "Manor Road"), (2, "Oak Lane")], "request_id int, name string")
    got = {r.request_id: (r.n_matched, r.n_total, r.roads_present) for r in roads.road_overlap(asked, near).collect()}
    assert got == {1: (2, 3, True), 2: (0, 0, False), 3: (0, 1, False)}


def test_slices_and_appends(spark, tmp_path):
    cases = spark.createDataFrame([(f"c{i:02d}",) for i in range(20)], "case_id string")
    assert [r[0] for r in incremental.case_slice(cases, 5, 3).orderBy("case_id").collect()] == ["c05", "c06", "c07"]
    assert incremental.case_slice(cases, 15).count() == 5
    assert incremental.case_slice(cases, 5, 3, only=["c01"]).count() == 1
    path = str(tmp_path / "done")
    incremental.append_missing(cases.where("case_id < 'c05'"), path)
    incremental.append_missing(cases, path)
    assert spark.read.parquet(path).count() == 20
