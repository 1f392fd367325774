"""Queries of the evaluation family: scores, breakdowns, costs and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.evaluate import scores as sc
from sitewise.evaluate import telemetry as tm
from sitewise.functions import text as tx
from sitewise.operators import ranking
from sitewise.plans.bindings import Inputs
from sitewise.plans.registry import query


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


_LABELLED = """
    s AS (SELECT trim(replace(lower(trim(colour)), '?', '')) AS colour,
                 trim(replace(lower(trim(quality)), '?', '')) AS quality,
                 trim(replace(lower(trim(complexity)), '?', '')) AS complexity,
                 coalesce(CASE WHEN worker_first_iou IS NULL THEN iou ELSE worker_first_iou END, 0) AS v
          FROM case_label JOIN case_result ON folder = case_id)"""


def _bucket_sql(dim: str, known: str) -> str:
    return f"""SELECT '{dim}' AS dimension, {dim} AS bucket, count(*) AS n, round(avg(v), 6) AS mean_iou,
        round(100.0 * count(*) FILTER (WHERE v >= 0.8) / count(*), 6) AS pct_ge_08,
        (SELECT count(*) FROM s WHERE {dim} NOT IN ({known})) = 0 AS covered
        FROM s WHERE {dim} IN ({known}) GROUP BY {dim}"""


@query("attr_breakdown", "case_label", "case_result", sql=f"""WITH {_LABELLED}
    SELECT 'total' AS dimension, 'all' AS bucket, count(*) AS n, round(avg(v), 6) AS mean_iou,
        round(100.0 * count(*) FILTER (WHERE v >= 0.8) / count(*), 6) AS pct_ge_08, true AS covered FROM s
    UNION ALL {_bucket_sql('colour', "'white','yellow'")}
    UNION ALL {_bucket_sql('quality', "'good','bad'")}
    UNION ALL {_bucket_sql('complexity', "'easy','medium','hard'")}""")
def attr_breakdown(i: Inputs):
    iou, _ = sc.worker_first()
    scores = i.bind("case_result").select(F.col("case_id").alias("folder"), iou.alias("iou"))
    table = sc.attribute_breakdown(i.bind("case_label"), scores)
    return table.select("dimension", "bucket", "n", _r("mean_iou"), _r("pct_ge_08"), "covered")


_HEADLINE = """count(*) AS n_cases, round(100 * avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6) AS pct_grt_0,
    round(avg(v), 6) AS mean_iou, round(quantile_cont(v, 0.5), 6) AS median_iou,
    round(100 * avg(CASE WHEN v >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS pct_grt_08,
    round(quantile_cont(d, 0.5), 4) AS median_distance_m,
    round(100 * avg(CASE WHEN d <= 0.1 * span_m THEN 1.0 ELSE 0.0 END), 6) AS acc_01d"""


@query("headline_metrics", "case_label", "case_result", sql=f"""WITH
    s AS (SELECT fold, coalesce(iou, 0) AS v, coalesce(err_m, CAST('Infinity' AS DOUBLE)) AS d, span_m
          FROM case_result JOIN case_label ON folder = case_id)
    SELECT CAST(NULL AS INT) AS fold, {_HEADLINE} FROM s UNION ALL SELECT fold, {_HEADLINE} FROM s GROUP BY fold""")
def headline_metrics(i: Inputs):
    cases = i.bind("case_result").join(
        i.bind("case_label").select(F.col("folder").alias("case_id"), "span_m"), "case_id"
    ).select("fold", "iou", F.col("err_m").alias("distance"), F.col("span_m").alias("span"))
    return sc.headline(cases, ["fold"], total=True).select(
        "fold", "n_cases", _r("pct_grt_0"), _r("mean_iou"), _r("median_iou"), _r("pct_grt_08"),
        _r("median_distance_m", 4), _r("acc_01d"),
    )


def _stat_sql(value: str, name: str, digits: int = 6, n: bool = True) -> str:
    parts = [f"count({value}) AS {name}_n"] if n else []
    parts += [
        f"round(avg({value}), {digits}) AS {name}_mean", f"round(quantile_cont({value}, 0.5), {digits}) AS {name}_median",
        f"round(stddev_pop({value}), {digits}) AS {name}_std", f"round(min({value}), {digits}) AS {name}_min",
        f"round(max({value}), {digits}) AS {name}_max",
    ]
    return ", ".join(parts)


@query("run_summary", "case_result", sql=f"""WITH
    s AS (SELECT status, iou, CASE WHEN status = 'crashed' THEN 0 ELSE coalesce(iou, 0) END AS v,
          CASE WHEN status <> 'crashed' AND iou IS NOT NULL THEN iou END AS a,
          CASE WHEN status <> 'crashed' AND iou IS NOT NULL THEN prec END AS b,
          CASE WHEN status <> 'crashed' AND iou IS NOT NULL THEN rec END AS c,
          CASE WHEN status <> 'crashed' AND iou IS NOT NULL THEN err_m END AS d FROM case_result)
    SELECT count(*) AS total, count(*) FILTER (WHERE status <> 'crashed' AND iou IS NOT NULL) AS polygons_produced,
        count(*) FILTER (WHERE status <> 'crashed' AND iou IS NULL) AS no_polygon,
        count(*) FILTER (WHERE status = 'crashed') AS crashed,
        {_stat_sql('v', 'iou', n=False)}, {_stat_sql('a', 'ok_iou')}, {_stat_sql('b', 'ok_precision')},
        {_stat_sql('c', 'ok_recall')}, {_stat_sql('d', 'ok_distance')} FROM s""")
def run_summary(i: Inputs):
    out = sc.run_summary(i.bind("case_result"))
    counts = {"total", "polygons_produced", "no_polygon", "crashed"}
    return out.select(*[c if c in counts or c.endswith("_n") else _r(c) for c in out.columns])


@query("page_to_case", "case_page", sql="""
    SELECT regexp_replace(page_id, '_p[0-9]+$', '') AS case_id, count(*) AS n_pages, round(avg(iou), 9) AS iou,
        round(avg(err_m), 7) AS err_m FROM case_page GROUP BY 1""")
def page_to_case(i: Inputs):
    cases = sc.pages_to_cases(i.bind("case_page"), ["iou", "err_m"])
    return cases.select("case_id", "n_pages", "iou", _r("err_m", 7))


@query("fold_cv", "case_page", sql="""WITH
    c AS (SELECT regexp_replace(page_id, '_p[0-9]+$', '') AS case_id, max(fold) AS fold, round(avg(iou), 9) AS iou,
                 round(avg(prec), 9) AS prec FROM case_page GROUP BY 1),
    f AS (SELECT fold, count(*) AS n, avg(iou) AS iou, avg(prec) AS prec FROM c GROUP BY fold)
    SELECT fold, n, round(iou, 6) AS iou, round(prec, 6) AS prec, CAST(NULL AS DOUBLE) AS iou_std,
        CAST(NULL AS DOUBLE) AS prec_std FROM f
    UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), round(avg(iou), 6), round(avg(prec), 6),
        round(stddev_pop(iou), 6), round(stddev_pop(prec), 6) FROM f""")
def fold_cv(i: Inputs):
    t = sc.fold_table(i.bind("case_page"), ["iou", "prec"])
    return t.select("fold", "n", _r("iou"), _r("prec"), _r("iou_std"), _r("prec_std"))


def _agg_row(metric: str, value: str, digits: int) -> str:
    return f"""SELECT '{metric}' AS metric, count({value}) AS n, round(avg({value}), {digits}) AS mean,
        round(quantile_cont({value}, 0.5), {digits}) AS median, round(stddev_pop({value}), {digits}) AS std,
        round(min({value}), {digits}) AS min, round(max({value}), {digits}) AS max FROM case_result"""


@query("aggregate_stats", "case_result", sql=" UNION ALL ".join([
    _agg_row("iou", "iou", 5), _agg_row("precision", "prec", 5), _agg_row("err_m", "err_m", 5)]))
def aggregate_stats(i: Inputs):
    t = sc.aggregate_stats(
        i.bind("case_result"), {"iou": F.col("iou"), "precision": F.col("prec"), "err_m": F.col("err_m")}
    )
    return t.select("metric", "n", *[_r(c, 5) for c in ("mean", "median", "std", "min", "max")])


_UPPER = "SELECT fold, iou, row_number() OVER (PARTITION BY fold ORDER BY iou) AS rn, count(*) OVER (PARTITION BY fold) AS n"


@query("threshold_summary", "case_result", sql=f"""WITH
    s AS ({_UPPER} FROM case_result WHERE iou IS NOT NULL)
    SELECT fold, count(*) AS n, round(avg(iou), 6) AS mean,
        round(max(CASE WHEN rn = n // 2 + 1 THEN iou END), 6) AS median,
        round(avg(CASE WHEN iou >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS ge_50,
        round(avg(CASE WHEN iou >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS ge_70,
        round(avg(CASE WHEN iou >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS ge_80,
        round(avg(CASE WHEN iou >= 0.9 THEN 1.0 ELSE 0.0 END), 6) AS ge_90 FROM s GROUP BY fold""")
def threshold_summary(i: Inputs):
    t = sc.threshold_summary(i.bind("case_result"), ["fold"], "iou")
    return t.select("fold", "n", *[_r(c) for c in ("mean", "median", "ge_50", "ge_70", "ge_80", "ge_90")])


@query("distance_summary", "case_result", sql="""WITH
    s AS (SELECT 'picks' AS label, err_m AS d FROM case_result WHERE err_m IS NOT NULL
          UNION ALL SELECT 'whole run', CASE WHEN worker_first_iou IS NULL THEN coalesce(err_m, CAST('Infinity' AS DOUBLE))
                    ELSE coalesce(worker_first_err_m, CAST('Infinity' AS DOUBLE)) END FROM case_result),
    r AS (SELECT label, d, row_number() OVER (PARTITION BY label ORDER BY d) AS rn, count(*) OVER (PARTITION BY label) AS n FROM s)
    SELECT label, count(*) AS n, round(CASE WHEN label = 'picks' THEN avg(CASE WHEN d < 1e300 THEN d END) / 1000 END, 6) AS mean_km,
        round(max(CASE WHEN rn = n // 2 + 1 THEN d END) / 1000, 6) AS upper_median_km,
        round(min(d) / 1000, 6) AS min_km, round(quantile_cont(d, 0.5), 4) AS median_m,
        round(100 * avg(CASE WHEN d < 500 THEN 1.0 ELSE 0.0 END), 6) AS pct_lt_500m,
        round(100 * avg(CASE WHEN d < 1000 THEN 1.0 ELSE 0.0 END), 6) AS pct_lt_1km FROM r GROUP BY label""")
def distance_summary(i: Inputs):
    """Picks leave failures out, the whole run counts them as infinitely far."""
    cases = i.bind("case_result")
    _, err = sc.worker_first()
    rows = sc.long_values(cases, [], {"picks": F.col("err_m"), "whole run": sc.missed(err)})
    t = sc.distance_summary(rows, ["metric"], "value")
    return t.select(
        F.col("metric").alias("label"), "n", F.round(F.when(F.col("metric") == "picks", F.col("mean_km")), 6).alias("mean_km"),
        _r("upper_median_km"), _r("min_km"), _r("median_m", 4), _r("pct_lt_500m"), _r("pct_lt_1km"),
    )


@query("method_comparison", "case_page", sql="""WITH
    p AS (SELECT method, page_id, iou, row_number() OVER (PARTITION BY method, page_id
              ORDER BY s1 DESC, s2 DESC, s3 DESC, s4 DESC, iou DESC) AS rn FROM case_page WHERE iou IS NOT NULL),
    c AS (SELECT method, regexp_replace(page_id, '_p[0-9]+$', '') AS case_id, round(avg(iou), 9) AS iou
          FROM p WHERE rn = 1 GROUP BY 1, 2),
    m AS (SELECT method, count(*) AS n, avg(iou) AS mean, quantile_cont(iou, 0.5) AS median,
              100 * avg(CASE WHEN iou >= 0.5 THEN 1.0 ELSE 0.0 END) AS a,
              100 * avg(CASE WHEN iou >= 0.8 THEN 1.0 ELSE 0.0 END) AS b FROM c GROUP BY method)
    SELECT method, n, round(mean, 6) AS mean, round(median, 6) AS median, round(a, 6) AS pct_ge_05,
        round(b, 6) AS pct_ge_08, CAST(row_number() OVER (ORDER BY round(mean, 9) DESC, method) AS INT) AS place FROM m""")
def method_comparison(i: Inputs):
    t = sc.method_comparison(i.bind("case_page"))
    return t.select("method", "n", *[_r(c) for c in ("mean", "median", "pct_ge_05", "pct_ge_08")], "place")


_REVISION = """
    s AS (SELECT case_id, coalesce(CASE WHEN worker_first_iou IS NULL THEN iou ELSE worker_first_iou END, 0) AS b,
                 coalesce(iou, 0) AS a FROM case_result)"""


@query("revision_delta", "case_result", sql=f"""WITH {_REVISION}
    SELECT count(*) AS n_cases, count(*) FILTER (WHERE abs(a - b) > 1e-9) AS n_changed, round(avg(b), 6) AS mean_before,
        round(avg(a), 6) AS mean_after, round(avg(a) - avg(b), 6) AS delta FROM s""")
def revision_delta(i: Inputs):
    t = sc.revision_delta(i.bind("case_result"))
    return t.select("n_cases", "n_changed", _r("mean_before"), _r("mean_after"), _r("delta"))


@query("revised_cases", "case_result", sql=f"""WITH {_REVISION}
    SELECT case_id, round(b, 6) AS before, round(a, 6) AS after FROM s WHERE abs(a - b) > 1e-9""")
def revised_cases(i: Inputs):
    return sc.revised_cases(i.bind("case_result")).select("case_id", _r("before"), _r("after"))


@query("run_rates", "case_result", sql="""WITH
    s AS (SELECT coalesce(iou, 0) AS v, status FROM case_result),
    r AS (SELECT v, status, row_number() OVER (ORDER BY v) AS rn, count(*) OVER () AS n FROM s)
    SELECT count(*) AS n, round(avg(v), 6) AS mean, round(max(CASE WHEN rn = n // 2 + 1 THEN v END), 6) AS median,
        round(avg(CASE WHEN v >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS ge_50,
        round(avg(CASE WHEN v >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS ge_80,
        round(100 * avg(CASE WHEN status = 'ok' THEN 1.0 ELSE 0.0 END), 6) AS valid_rate,
        round(100 * avg(CASE WHEN status = 'crashed' THEN 1.0 ELSE 0.0 END), 6) AS schema_fail_rate FROM r""")
def run_rates(i: Inputs):
    rows = i.bind("case_result").select(
        "iou", (F.col("status") == "ok").alias("valid_pred"), (F.col("status") == "crashed").alias("schema_failure")
    )
    t = sc.run_rates(rows)
    return t.select("n", *[_r(c) for c in ("mean", "median", "ge_50", "ge_80", "valid_rate", "schema_fail_rate")])


@query("label_score_audit", "case_label", "case_result", sql="""
    SELECT 'missing' AS kind, folder AS case_id FROM case_label WHERE folder NOT IN (SELECT case_id FROM case_result)
    UNION ALL SELECT 'extra', case_id FROM case_result WHERE case_id NOT IN (SELECT folder FROM case_label)""")
def label_score_audit(i: Inputs):
    """Labels without a score and scores without a label."""
    labels = i.bind("case_label").select(F.col("folder").alias("case_id"))
    scores = i.bind("case_result").select("case_id")
    missing = labels.join(scores, "case_id", "left_anti").select(F.lit("missing").alias("kind"), "case_id")
    extra = scores.join(labels, "case_id", "left_anti").select(F.lit("extra").alias("kind"), "case_id")
    return missing.unionByName(extra)


_WANTED = "wanted AS (SELECT DISTINCT concat('C', CAST(c_custkey * 11 AS STRING)) AS case_id FROM customer)"


@query("subset_metrics", "case_result", sql=f"""WITH {_WANTED}
    SELECT 'kept' AS kind, count(*) AS n, round(avg(coalesce(iou, 0)), 6) AS mean_iou FROM case_result
    WHERE case_id IN (SELECT case_id FROM wanted)
    UNION ALL SELECT 'unknown', count(*), NULL FROM wanted WHERE case_id NOT IN (SELECT case_id FROM case_result)""")
def subset_metrics(i: Inputs):
    """Scores of the named cases only, and how many names are unknown."""
    wanted = i.table("customer").select(F.concat(F.lit("C"), (F.col("c_custkey") * 11).cast("string")).alias("case_id"))
    wanted = wanted.distinct()
    cases = i.bind("case_result")
    kept = cases.join(wanted, "case_id", "left_semi").agg(
        F.count("*").alias("n"), F.round(F.avg(sc.honest(F.col("iou"))), 6).alias("mean_iou")
    ).select(F.lit("kept").alias("kind"), "n", "mean_iou")
    unknown = wanted.join(cases.select("case_id"), "case_id", "left_anti").agg(F.count("*").alias("n"))
    return kept.unionByName(unknown.select(F.lit("unknown").alias("kind"), "n", F.lit(None).cast("double").alias("mean_iou")))


@query("key_overlap", "case_label", "case_result", sql="""
    SELECT folder AS case_id FROM case_label INTERSECT SELECT case_id FROM case_result WHERE status = 'ok'""")
def key_overlap(i: Inputs):
    """Requested keys that are available."""
    ok = i.bind("case_result").where("status = 'ok'").select("case_id")
    return i.bind("case_label").select(F.col("folder").alias("case_id")).intersect(ok)


@query("pose_auc", "case_page", sql="""WITH
    e AS (SELECT fold, err_m AS v FROM case_page WHERE err_m IS NOT NULL),
    r AS (SELECT fold, v, row_number() OVER (PARTITION BY fold ORDER BY v) AS i, count(*) OVER (PARTITION BY fold) AS n,
                 coalesce(lag(v) OVER (PARTITION BY fold ORDER BY v), 0) AS p FROM e),
    t AS (SELECT CAST(unnest([50, 250, 500, 800]) AS DOUBLE) AS threshold),
    a AS (SELECT fold, threshold, coalesce(sum(CASE WHEN v < threshold THEN (v - p) * (2 * i - 1) / 2.0 / n END), 0) AS area,
              coalesce(max(CASE WHEN v < threshold THEN v END), 0) AS last,
              coalesce(max(CASE WHEN v < threshold THEN i * 1.0 / n END), 0) AS recall FROM r, t GROUP BY 1, 2)
    SELECT fold, threshold, round((area + (threshold - last) * recall) / threshold, 6) AS auc FROM a""")
def pose_auc(i: Inputs):
    errors = i.bind("case_page").where("err_m IS NOT NULL").select("fold", "err_m")
    return sc.error_auc(errors, ["fold"], "err_m", [50, 250, 500, 800]).select("fold", "threshold", _r("auc"))


@query("distance_precision", "case_page", sql="""WITH
    p AS (SELECT regexp_replace(page_id, '_p[0-9]+$', '') AS c,
                 coalesce(count(*) FILTER (WHERE err_m < 300) * 1.0 / nullif(count(err_m), 0), 0) AS p FROM case_page GROUP BY 1)
    SELECT round(avg(p), 6) AS precision FROM p""")
def distance_precision(i: Inputs):
    pages = i.bind("case_page").select(tx.page_case(F.col("page_id")).alias("c"), "err_m")
    return sc.distance_precision(pages, "c", "err_m", 300).select(_r("precision"))


@query("last_identifier", "case_page", sql="""WITH
    r AS (SELECT page_id, method, err_m, row_number() OVER (PARTITION BY page_id
              ORDER BY s1 DESC, s2 DESC, s3 DESC, s4 DESC) AS rn FROM case_page)
    SELECT page_id, method, err_m FROM r WHERE rn = 1""")
def last_identifier(i: Inputs):
    pages = i.bind("case_page").withColumn("seq", F.struct("s1", "s2", "s3", "s4"))
    return sc.last_of_identifier(pages, "page_id", "seq").select("page_id", "method", "err_m")


_EPOCHS = """
    b AS (SELECT fold, epoch, val, max(val) OVER (PARTITION BY fold ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING
              AND 1 PRECEDING) AS before FROM epoch),
    n AS (SELECT fold, epoch, val, CASE WHEN before IS NULL OR val > before THEN epoch END AS best_here,
                 row_number() OVER (PARTITION BY fold ORDER BY epoch) AS i,
                 CASE WHEN before IS NULL OR val > before THEN row_number() OVER (PARTITION BY fold ORDER BY epoch) END AS bi FROM b),
    s AS (SELECT fold, epoch, val, i, i - max(bi) OVER (PARTITION BY fold ORDER BY epoch) AS since,
                 max(val) OVER (PARTITION BY fold ORDER BY epoch) AS best_so_far FROM n),
    k AS (SELECT s.* FROM s WHERE i <= coalesce((SELECT min(t.i) FROM s t WHERE t.fold = s.fold AND t.since >= 2), 1000000))"""


@query("early_stop", "epoch", sql=f"""WITH {_EPOCHS}
    SELECT fold, epoch, val, best_so_far, CAST(since AS INT) AS since FROM k""")
def early_stop(i: Inputs):
    kept = tm.kept_epochs(i.bind("epoch"), 2)
    return kept.select("fold", "epoch", "val", "best_so_far", F.col("since").cast("int").alias("since"))


@query("best_epoch", "epoch", sql=f"""WITH {_EPOCHS}
    SELECT fold, min(epoch) FILTER (WHERE val = m) AS best_epoch, max(val) AS best_val, max(epoch) AS stopped_at,
        CAST(max(since) FILTER (WHERE epoch = e) AS INT) AS epochs_since_best
    FROM (SELECT *, max(val) OVER (PARTITION BY fold) AS m, max(epoch) OVER (PARTITION BY fold) AS e FROM k) GROUP BY fold""")
def best_epoch(i: Inputs):
    b = tm.best_epochs(i.bind("epoch"), 2)
    return b.select("fold", "best_epoch", "best_val", "stopped_at", F.col("epochs_since_best").cast("int").alias("epochs_since_best"))


@query("tool_counts", "tool_message", sql="""WITH
    t AS (SELECT case_id, count(DISTINCT turn) AS n_turns, count(*) FILTER (WHERE kind LIKE 'retryprompt%') AS retries
          FROM tool_message GROUP BY case_id),
    c AS (SELECT case_id, tool_name, count(*) AS n FROM tool_message WHERE kind LIKE '%toolcall%' GROUP BY 1, 2),
    m AS (SELECT case_id, string_agg(concat(tool_name, '=', CAST(n AS STRING)), ',' ORDER BY tool_name) AS tools FROM c GROUP BY 1)
    SELECT t.case_id, coalesce(tools, '') AS tools, n_turns, retries FROM t LEFT JOIN m ON t.case_id = m.case_id""")
def tool_counts(i: Inputs):
    t = tm.tool_counts(i.bind("tool_message"))
    tools = F.array_join(
        F.transform(F.map_entries("tool_calls"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    )
    return t.select("case_id", tools.alias("tools"), "n_turns", "retries")


_PRICE_KEYS = "CASE model WHEN 'en' THEN 'gemini-flash' WHEN 'de' THEN 'gemini-pro' WHEN 'fr' THEN 'claude-opus' END"


@query("stage_cost", "usage", sql=f"""WITH
    p AS (SELECT * FROM (VALUES ('gemini-flash', 0.55, 2.2), ('gemini-pro', 1.25, 12.5), ('claude-opus', 5.0, 25.0),
          ('gpt-5.5-pro', 30.0, 180.0)) v(price_key, pin, pout)),
    u AS (SELECT *, {_PRICE_KEYS} AS price_key FROM usage),
    c AS (SELECT model, call_seconds, (tokens_in * CAST(pin AS DOUBLE) + tokens_out * CAST(pout AS DOUBLE)) / 1e6 AS cost
          FROM u LEFT JOIN p ON u.price_key = p.price_key)
    SELECT model, count(*) AS n, round(avg(cost), 6) AS mean_cost, round(avg(CAST(call_seconds AS DOUBLE)), 4) AS mean_secs
    FROM c GROUP BY model""")
def stage_cost(i: Inputs):
    """Mean cost and time per model; models without a price keep a NULL cost."""
    usage = i.bind("usage").withColumn("price_key", F.expr(_PRICE_KEYS))
    costs = tm.call_costs(usage, tm.price_table(i.spark))
    return costs.groupBy("model").agg(
        F.count("*").alias("n"), F.round(F.avg("cost"), 6).alias("mean_cost"),
        F.round(F.avg(F.col("call_seconds").cast("double")), 4).alias("mean_secs"),
    )


@query("document_cost", "usage", "tool_message", sql="""WITH
    c AS (SELECT case_id, tokens_in, tokens_out, (tokens_in * 0.55 + tokens_out * 2.2) / 1e6 AS cost,
                 CAST(call_seconds AS DOUBLE) AS secs FROM usage),
    t AS (SELECT case_id, count(*) AS k FROM tool_message GROUP BY 1)
    SELECT round(avg(CAST(cost AS DOUBLE)), 8) AS mean_cost,
        round(avg(CAST(cost + coalesce(k, 0) * (100 * 0.55 + 20 * 2.2) / 1e6 AS DOUBLE)), 8) AS mean_cost_revised,
        round(avg(secs - coalesce(k, 0) * 1.5), 4) AS mean_secs, round(avg(secs), 4) AS mean_secs_revised
    FROM c LEFT JOIN t ON c.case_id = t.case_id""")
def document_cost(i: Inputs):
    """Cost and time per document with and without the revision, from nested run statistics."""
    turns = i.bind("tool_message").groupBy("case_id").agg(F.count("*").alias("k"))
    usage = i.bind("usage").join(turns, "case_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    none = F.lit(None).cast("bigint")
    step = F.struct(F.lit("approve").alias("action"), F.lit(1.5).alias("wall_s"))
    stats = F.struct(
        F.col("tokens_in").alias("reader_request_tokens"), F.col("tokens_out").alias("reader_response_tokens"),
        none.alias("worker_request_tokens"), none.alias("worker_response_tokens"),
        none.alias("locate_request_tokens"), none.alias("locate_response_tokens"),
        F.when(F.col("k") > 0, F.struct(
            F.array_repeat(step, F.col("k").cast("int")).alias("iterations"),
            F.struct((F.col("k") * 100).alias("request"), (F.col("k") * 20).alias("response")).alias("tokens"),
        )).alias("critic"),
    )
    cases = usage.select("case_id", F.col("call_seconds").cast("double").alias("processing_time"), stats.alias("agent_stats"))
    costs = tm.mean_costs(tm.case_costs(cases, tm.PRICES["gemini-flash"]))
    return costs.select(_r("mean_cost", 8), _r("mean_cost_revised", 8), _r("mean_secs", 4), _r("mean_secs_revised", 4))


@query("token_totals", "usage", sql="""
    SELECT source AS case_id, count(*) AS n_calls, CAST(sum(tokens_in) AS BIGINT) AS request,
        CAST(sum(tokens_out) AS BIGINT) AS response, CAST(sum(tokens_in) + sum(tokens_out) AS BIGINT) AS total
    FROM usage GROUP BY source""")
def token_totals(i: Inputs):
    calls = i.bind("usage").select(
        F.col("source").alias("case_id"), F.col("tokens_in").alias("request"), F.col("tokens_out").alias("response")
    )
    return tm.token_totals(calls)


@query("rejection_count", "tool_message", sql="""
    SELECT case_id, CAST(count(*) FILTER (WHERE tool_name <> 'propose_centers' OR kind = 'retryprompt') AS INT) AS n_rejections
    FROM tool_message GROUP BY case_id""")
def rejection_count(i: Inputs):
    """Steps that were not approved or failed."""
    steps = i.bind("tool_message").select(
        "case_id",
        F.when(F.col("tool_name") == "propose_centers", "approve").otherwise("switch").alias("action"),
        F.when(F.col("kind") == "retryprompt", "failed").alias("llm_error"),
    )
    return tm.rejection_counts(steps)


@query("token_change", "usage", sql="""WITH
    a AS (SELECT avg(tokens_in) AS run_tokens FROM usage), b AS (SELECT avg(tokens_in + tokens_out) AS other_tokens FROM usage)
    SELECT round(run_tokens, 4) AS run_tokens, round(other_tokens, 4) AS other_tokens,
        round(100 * (run_tokens / other_tokens - 1), 6) AS change_pct FROM a, b""")
def token_change(i: Inputs):
    usage = i.bind("usage")
    run = usage.select(F.col("tokens_in").alias("total_tokens"))
    other = usage.select((F.col("tokens_in") + F.col("tokens_out")).alias("total_tokens"))
    return tm.token_change(run, other).select(_r("run_tokens", 4), _r("other_tokens", 4), _r("change_pct"))


_PAGES = """
    SELECT l_orderkey AS doc_id, CAST(l_suppkey % 3 AS INT) AS area_group, CAST(l_linenumber AS INT) AS page,
           CASE l_returnflag WHEN 'A' THEN 'clear' WHEN 'N' THEN 'ambiguous' ELSE 'none' END AS boundary_clarity,
           CASE l_partkey % 3 WHEN 0 THEN 'close' WHEN 1 THEN 'medium' ELSE 'wide' END AS detail_level,
           CASE WHEN l_linestatus = 'O' THEN 'match' ELSE 'discard' END AS category
    FROM lineitem"""


@query("primary_page", sql=f"""WITH p AS ({_PAGES}),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, area_group ORDER BY
              CASE boundary_clarity WHEN 'clear' THEN 1 WHEN 'ambiguous' THEN 2 ELSE 3 END,
              CASE detail_level WHEN 'wide' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, page) AS rn FROM p WHERE category = 'match')
    SELECT doc_id, area_group, page FROM r WHERE rn = 1""")
def primary_page(i: Inputs):
    pages = i.spark.sql(_PAGES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=i.table("lineitem"))
    return ranking.primary_pages(pages)


@query("group_lines", sql=f"""WITH p AS (SELECT DISTINCT doc_id, area_group, page FROM ({_PAGES}) WHERE category = 'match'),
    g AS (SELECT doc_id, area_group, string_agg(CAST(page AS STRING), ', ' ORDER BY page) AS pages, min(page) AS first,
                 string_agg(CAST(page AS STRING), ', ' ORDER BY page) FILTER (WHERE page <> m) AS rest
          FROM (SELECT *, min(page) OVER (PARTITION BY doc_id, area_group) AS m FROM p) GROUP BY 1, 2)
    SELECT doc_id, area_group, concat('Group ', CAST(area_group AS STRING), ': pages [', pages, '] (primary=',
        CAST(first AS STRING), CASE WHEN rest IS NULL THEN '' ELSE concat(', alternates=[', rest, ']') END, ')') AS line FROM g""")
def group_lines(i: Inputs):
    pages = i.spark.sql(_PAGES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=i.table("lineitem"))
    listed = pages.where("category = 'match'").select("doc_id", "area_group", "page").distinct()
    return tm.group_lines(listed.withColumn("rank", F.col("page")))
