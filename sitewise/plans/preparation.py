"""Queries of the preparation family: strata, folds, splits and resumable runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitewise.evaluate import scores as sc
from sitewise.functions import text as tx
from sitewise.plans.bindings import Inputs
from sitewise.plans.registry import query
from sitewise.prep import folds, incremental, strata
from sitewise.session import checkpoint_dir
from sitewise.sources import sinks

SUBSET, SEED = 40, 42

_CLEAN = """
    k AS (SELECT folder, concat(trim(replace(lower(trim(quality)), '?', '')), '_x_',
                                trim(replace(lower(trim(complexity)), '?', ''))) AS stratum
          FROM case_label WHERE lower(trim(shape_matches)) = 'yes' OR lower(trim(shape_matches)) LIKE 'yes - across%'),
    pop AS (SELECT stratum, count(*) AS population FROM k GROUP BY stratum)"""
_ALLOC = _CLEAN + f""",
    b AS (SELECT *, least(2, population) AS base, population - least(2, population) AS cap FROM pop),
    r AS (SELECT *, ({SUBSET} - sum(base) OVER ()) * (CAST(cap AS DOUBLE) / sum(cap) OVER ()) AS raw FROM b),
    f AS (SELECT *, base + least(CAST(floor(raw) AS BIGINT), cap) AS a FROM r),
    t AS (SELECT *, row_number() OVER (PARTITION BY a < population ORDER BY raw - floor(raw) DESC, stratum) AS place,
                 {SUBSET} - sum(a) OVER () AS missing FROM f),
    alloc AS (SELECT stratum, population, CAST(a + CASE WHEN a < population AND place <= missing THEN 1 ELSE 0 END AS BIGINT) AS alloc FROM t)"""


@query("label_sheet", "case_label", sql="""
    SELECT folder, trim(replace(lower(trim(colour)), '?', '')) AS colour, trim(replace(lower(trim(quality)), '?', '')) AS quality,
        trim(replace(lower(trim(complexity)), '?', '')) AS complexity FROM case_label""")
def label_sheet(i: Inputs):
    columns = [tx.normalise_label(F.col(c)).alias(c) for c in ("colour", "quality", "complexity")]
    return i.bind("case_label").select("folder", *columns)


@query("strata", "case_label", sql=f"WITH {_CLEAN} SELECT * FROM pop")
def strata_counts(i: Inputs):
    return strata.populations(strata.clean_cases(i.bind("case_label")))


@query("allocate_strata", "case_label", sql=f"WITH {_ALLOC} SELECT * FROM alloc")
def allocate_strata(i: Inputs):
    return strata.allocate(strata.populations(strata.clean_cases(i.bind("case_label"))), SUBSET)


@query("stratified_sample", "case_label", sql=f"""WITH {_ALLOC},
    d AS (SELECT folder, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat('{SEED}:', folder)), folder) AS rn FROM k)
    SELECT folder, d.stratum FROM d JOIN alloc ON d.stratum = alloc.stratum WHERE rn <= alloc""")
def stratified_sample(i: Inputs):
    clean = strata.clean_cases(i.bind("case_label"))
    alloc = strata.allocate(strata.populations(clean), SUBSET)
    return strata.sample(clean, alloc, SEED, SUBSET)


@query("resume_todo", "case_label", "case_result", sql="""
    SELECT folder AS case_id FROM case_label WHERE folder NOT IN (SELECT case_id FROM case_result WHERE status <> 'crashed')""")
def resume_todo(i: Inputs):
    cases = i.bind("case_label").select(F.col("folder").alias("case_id"))
    return incremental.todo(cases, i.bind("case_result").where("status <> 'crashed'"))


@query("cache_decision", "case_label", "case_result", sql="""WITH
    j AS (SELECT folder AS case_id, status, coalesce(worker_first_iou IS NOT NULL, false) AS had,
                 coalesce(fold = 3, false) AS district FROM case_label LEFT JOIN case_result ON folder = case_id)
    SELECT case_id, CASE WHEN status IS NULL THEN false WHEN status = 'crashed' THEN false
        WHEN had <> true AND NOT district AND NOT (status = 'no_prediction' AND NOT had) THEN false ELSE true END AS reuse FROM j""")
def cache_decision(i: Inputs):
    cases = i.bind("case_label").select(F.col("folder").alias("case_id"))
    previous = i.bind("case_result").select(
        "case_id", F.col("status").alias("prev_status"), F.col("worker_first_iou").isNotNull().alias("had_critic"),
        F.when(F.col("fold") == 3, "district_lookup").otherwise("accepted").alias("outcome_status"),
    )
    return incremental.cache_decision(cases, previous, retry_failed=True, enable_critic=True)


@query("case_slice", "case_label", sql="SELECT folder AS case_id FROM case_label ORDER BY folder LIMIT 100 OFFSET 50")
def case_slice(i: Inputs):
    return incremental.case_slice(i.bind("case_label").select(F.col("folder").alias("case_id")), 50, 100)


_ROUTE = "regexp_replace(replace(replace({0}, ':', '_'), '/', '_'), '_p[0-9]+$', '')"
_MAP = "m AS (SELECT concat('C:', CAST(o_orderkey AS STRING)) AS case_id, CAST(o_orderkey % 7 AS INT) AS fold FROM orders WHERE o_orderstatus <> 'P')"
_NAMED = "c AS (SELECT concat('C/', CAST(l_orderkey AS STRING), '_p', CAST(l_linenumber AS STRING)) AS case_id FROM lineitem)"


@query("fold_routing", sql=f"""WITH {_MAP}, {_NAMED},
    k AS (SELECT {_ROUTE.format('case_id')} AS k, max(fold) AS fold FROM m GROUP BY 1)
    SELECT case_id, CASE WHEN fold IN (1, 2, 3, 4, 5, 6) THEN fold ELSE 1 END AS fold
    FROM c LEFT JOIN k ON {_ROUTE.format('case_id')} = k.k""")
def fold_routing(i: Inputs):
    """Pages to the fold of their case; fold 0 is not available, so it falls back like unknown cases."""
    return folds.route_folds(_named_pages(i), _fold_map(i), [1, 2, 3, 4, 5, 6])


def _fold_map(i: Inputs):
    return i.table("orders").where("o_orderstatus <> 'P'").select(
        F.concat(F.lit("C:"), F.col("o_orderkey").cast("string")).alias("case_id"),
        (F.col("o_orderkey") % 7).cast("int").alias("fold"),
    )


def _named_pages(i: Inputs):
    return i.table("lineitem").select(
        F.concat(F.lit("C/"), F.col("l_orderkey").cast("string"), F.lit("_p"), F.col("l_linenumber").cast("string")).alias("case_id")
    )


@query("manifest", sql=f"""WITH {_MAP}, {_NAMED}
    SELECT m.case_id, concat(c.case_id, '.png') AS filename, fold FROM c JOIN m
    ON {_ROUTE.format('c.case_id')} = {_ROUTE.format('m.case_id')}""")
def manifest(i: Inputs):
    files = _named_pages(i).select(F.concat("case_id", F.lit(".png")).alias("filename"))
    return folds.manifest(files, _fold_map(i))


@query("complete_cases", sql="""
    SELECT l_orderkey AS case_id, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) = 1
            AND max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) = 1 AS complete,
        CASE WHEN max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) = 0 THEN 'missing map.png'
             WHEN max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) = 0 THEN 'missing edited_mask.png' END AS reason
    FROM lineitem GROUP BY 1""")
def complete_cases(i: Inputs):
    """Cases for which both files are there."""
    names = F.array_compact(F.array(
        F.when(F.col("l_linestatus") == "O", "map.png"), F.when(F.col("l_returnflag") == "A", "edited_mask.png"), F.lit("page.pdf")
    ))
    files = i.table("lineitem").select(F.col("l_orderkey").alias("case_id"), F.explode(names).alias("filename"))
    return folds.complete_cases(files)


@query("stay_together", "case_page", sql="""
    SELECT page_id AS case_id, CASE WHEN page_id = '12:00117:ART4' THEN '12:00141:ART4'
        ELSE regexp_replace(page_id, '_p[0-9]+$', '') END AS group_key FROM case_page""")
def stay_together(i: Inputs):
    pages = i.bind("case_page").select(F.col("page_id").alias("case_id"))
    return folds.with_group_key(pages, folds.explicit_groups(i.spark))


@query("group_counts", "case_page", sql="""
    SELECT fold, count(*) AS n_cases, count(DISTINCT regexp_replace(page_id, '_p[0-9]+$', '')) AS n_groups
    FROM case_page GROUP BY fold""")
def group_counts(i: Inputs):
    pages = i.bind("case_page").groupBy("fold", tx.page_case(F.col("page_id")).alias("g")).agg(F.count("*").alias("n"))
    return pages.groupBy("fold").agg(F.sum("n").alias("n_cases"), F.count("*").alias("n_groups"))


@query("lpt_folds", sql="""WITH RECURSIVE
    g AS (SELECT concat('G', CAST(o_custkey AS STRING)) AS group_key, count(*) AS n_members FROM orders GROUP BY o_custkey),
    o AS (SELECT *, row_number() OVER (ORDER BY n_members DESC, group_key) AS i FROM g),
    w AS (SELECT 0 AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, 0 AS fold
          UNION ALL
          SELECT w.i + 1,
              list_transform(range(1, 6), lambda f: loads[f] + CASE WHEN f = list_position(loads, list_min(loads)) THEN o.n_members ELSE 0 END),
              list_position(loads, list_min(loads)) - 1
          FROM w JOIN o ON o.i = w.i + 1)
    SELECT group_key, n_members, CAST(fold AS INT) AS fold FROM o JOIN w ON o.i = w.i""")
def lpt_folds(i: Inputs):
    cases = i.table("orders").select(F.concat(F.lit("G"), F.col("o_custkey").cast("string")).alias("group_key"))
    return folds.balanced_folds(cases)


@query("fold_split", "case_result", sql="""WITH
    f AS (SELECT unnest([0, 1, 2, 3, 4]) AS split_fold),
    s AS (SELECT case_id, fold, split_fold, CASE WHEN fold = split_fold THEN 'valid' ELSE 'train' END AS split FROM case_result, f)
    SELECT case_id, CAST(split_fold AS INT) AS split_fold, split, CAST(copy AS INT) AS copy FROM s, (SELECT unnest([1, 2]) AS copy)
    WHERE split = 'train' OR copy = 1""")
def fold_split(i: Inputs):
    return folds.fold_splits(i.bind("case_result").select("case_id", "fold")).select("case_id", "split_fold", "split", "copy")


_TURNS = "SELECT doc_id AS case_id, CAST(n_chars % 4 * 90 AS INT) AS degrees, CAST((n_chars + doc_id % 3) % 4 * 90 AS INT) AS pred FROM documents"


@query("rotation_expand", sql=f"""WITH t AS ({_TURNS})
    SELECT case_id, CAST(a AS INT) AS applied, CAST((degrees - a + 360) % 360 AS INT) AS label
    FROM t, (SELECT unnest([0, 90, 180, 270]) AS a)""")
def rotation_expand(i: Inputs):
    labels = i.spark.sql(_TURNS.replace("FROM documents", "FROM {documents}"), documents=i.table("documents"))
    return folds.rotation_samples(labels).select("case_id", "applied", "label")


@query("rotation_accuracy", sql=f"""WITH t AS ({_TURNS}),
    s AS (SELECT 'overall' AS split, degrees = pred AS hit FROM t UNION ALL
          SELECT CASE WHEN degrees = 0 THEN 'upright' ELSE 'rotated' END, degrees = pred FROM t)
    SELECT split, count(*) AS n, count(*) FILTER (WHERE hit) AS n_correct,
        round(count(*) FILTER (WHERE hit) * 1.0 / count(*), 6) AS accuracy FROM s GROUP BY split""")
def rotation_accuracy(i: Inputs):
    t = i.spark.sql(_TURNS.replace("FROM documents", "FROM {documents}"), documents=i.table("documents"))
    split = sc.accuracy_split(t.select("case_id", F.col("degrees").alias("truth")), t.select("case_id", "pred"))
    return split.select("split", "n", "n_correct", F.round("accuracy", 6).alias("accuracy"))


@query("latest_results", sql="""
    SELECT o_orderkey AS case_id, o_orderpriority AS run, CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'retried' END AS status,
        CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice + 1 END AS score FROM orders""")
def latest_results(i: Inputs):
    """A run's results written once for all cases, then again for the retried ones, and read back."""
    path = f"{checkpoint_dir(i.spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    first = i.table("orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("run"),
        F.when(F.col("o_orderstatus") == "F", "ok").otherwise("crashed").alias("status"), F.col("o_totalprice").alias("score"),
    )
    sinks.write_results(first, path)
    sinks.write_results(first.where("status = 'crashed'").withColumns({"status": F.lit("retried"), "score": F.col("score") + 1}), path)
    return i.spark.read.schema(first.schema).parquet(path)
