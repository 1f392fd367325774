"""Costs, times and call counts of a run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions import text as tx

# Dollars per million tokens (input, output) by price key.
PRICES = {
    "gemini-flash": (0.55, 2.20), "gemini-pro": (1.25, 12.50), "claude-opus": (5.00, 25.00),
    "gpt-5.5-pro": (30.0, 180.0),
}
STAGES = ("reader", "worker", "locate")


def price_table(spark: SparkSession, prices: Mapping[str, tuple[float, float]] = PRICES) -> DataFrame:
    """price_key, price_in, price_out: a dimension of a few rows."""
    return spark.createDataFrame(
        [(k, i, o) for k, (i, o) in prices.items()], "price_key string, price_in double, price_out double"
    )


def call_costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Add cost to usage rows with price_key, tokens_in, tokens_out; unpriced rows stay NULL."""
    priced = usage.join(F.broadcast(prices), "price_key", "left")
    cost = tx.token_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out"))
    return priced.withColumn("cost", cost).drop("price_in", "price_out")


def _tokens(path: str) -> Column:
    return F.coalesce(F.col(path), F.lit(0))


def case_costs(cases: DataFrame, price: tuple[float, float]) -> DataFrame:
    """case_id, cost, cost_revised, secs, secs_revised from nested run statistics.

    Without the revision its tokens and wall time are left out.
    """
    pin, pout = F.lit(price[0]), F.lit(price[1])
    base = sum(
        tx.token_cost(
            _tokens(f"agent_stats.{s}_request_tokens"), _tokens(f"agent_stats.{s}_response_tokens"), pin, pout
        )
        for s in STAGES
    )
    extra = tx.token_cost(
        _tokens("agent_stats.critic.tokens.request"), _tokens("agent_stats.critic.tokens.response"), pin, pout
    )
    wall = F.coalesce(
        F.aggregate(
            "agent_stats.critic.iterations", F.lit(0.0), lambda acc, i: acc + F.coalesce(i["wall_s"], F.lit(0.0))
        ),
        F.lit(0.0),
    )
    return cases.select(
        "case_id", base.alias("cost"), (base + extra).alias("cost_revised"),
        (F.col("processing_time") - wall).alias("secs"), F.col("processing_time").alias("secs_revised"),
    )


def mean_costs(costs: DataFrame) -> DataFrame:
    return costs.agg(*[F.avg(c).alias(f"mean_{c}") for c in ("cost", "cost_revised", "secs", "secs_revised")])


def token_change(run: DataFrame, other: DataFrame, tokens: str = "total_tokens") -> DataFrame:
    """One row: mean tokens of both runs and the change of `run` against `other` in percent."""
    a = run.agg(F.avg(tokens).alias("run_tokens")).withColumn("_k", F.lit(0))
    b = other.agg(F.avg(tokens).alias("other_tokens")).withColumn("_k", F.lit(0))
    change = 100 * (F.try_divide(F.col("run_tokens"), F.col("other_tokens")) - 1)
    return a.join(F.broadcast(b), "_k").drop("_k").withColumn("change_pct", change)


def tool_counts(messages: DataFrame) -> DataFrame:
    """case_id, tool_calls (map), n_turns, retries from one row per message part."""
    kind = F.lower("kind")
    calls = messages.where(F.contains(kind, F.lit("toolcall"))).groupBy("case_id", "tool_name").agg(
        F.count("*").alias("n")
    )
    maps = calls.groupBy("case_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool_name", "n")))).alias("tool_calls")
    )
    retry = (~F.contains(kind, F.lit("toolcall"))) & F.startswith(kind, F.lit("retryprompt"))
    # Turns are counted as distinct through a first aggregate, so one long case stays spread out.
    turns = messages.groupBy("case_id", "turn").agg(F.count_if(retry).alias("r")).groupBy("case_id").agg(
        F.count("*").alias("n_turns"), F.sum("r").alias("retries")
    )
    return turns.join(maps, "case_id", "left").withColumn(
        "tool_calls", F.coalesce("tool_calls", F.create_map().cast("map<string,bigint>"))
    )


def token_totals(calls: DataFrame) -> DataFrame:
    """case_id, n_calls, request, response, total per case from one row per call."""
    return calls.groupBy("case_id").agg(
        F.count("*").alias("n_calls"), F.sum("request").alias("request"), F.sum("response").alias("response")
    ).withColumn("total", F.col("request") + F.col("response"))


def rejected(action: Column, error: Column) -> Column:
    """An iteration that asked for a change or failed; one without an action that didn't fail is neither."""
    return F.coalesce(action != "approve", F.lit(False)) | error.isNotNull()


def rejections(iterations: Column) -> Column:
    """Rejected iterations of a list; none for null."""
    return F.size(F.filter(F.coalesce(iterations, F.array().cast("array<struct<action:string,llm_error:string>>")), lambda i: rejected(i["action"], i["llm_error"])))


def rejection_counts(steps: DataFrame) -> DataFrame:
    """case_id, n_rejections from one row per iteration (case_id, action, llm_error); no case's list is gathered."""
    return steps.groupBy("case_id").agg(F.count_if(rejected(F.col("action"), F.col("llm_error"))).cast("int").alias("n_rejections"))


def group_lines(pages: DataFrame) -> DataFrame:
    """doc_id, area_group, line: the match pages of a group in rank order, the first as primary.

    `pages` has doc_id, area_group, page, rank (the place in the document's ranked list).
    """
    listed = pages.groupBy("doc_id", "area_group").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "page"))), lambda r: r["page"].cast("string")).alias("p")
    )
    rest = F.slice("p", F.lit(2), F.size("p"))
    alternates = F.when(
        F.size("p") > 1, F.concat(F.lit(", alternates=["), F.array_join(rest, ", "), F.lit("]"))
    ).otherwise(F.lit(""))
    line = F.concat(
        F.lit("Group "), F.col("area_group").cast("string"), F.lit(": pages ["), F.array_join("p", ", "),
        F.lit("] (primary="), F.get("p", F.lit(0)), alternates, F.lit(")"),
    )
    return listed.select("doc_id", "area_group", line.alias("line"))


def metric_lines(attempts: DataFrame) -> DataFrame:
    """case_id, seq, line of one attempt as it is shown in a review."""
    road = F.coalesce(F.format_string("%.2f", F.col("road_score")), F.lit("?"))
    scale = F.coalesce(F.format_string("%.2f", F.col("scale_score")), F.lit("?"))
    verdict = F.when(F.length("road_verdict") > 0, F.concat(F.lit(" ("), F.col("road_verdict"), F.lit(")"))).otherwise("")
    line = F.concat(
        F.lit("  cand "), F.col("seq").cast("string"), F.lit("  group "),
        F.coalesce(F.col("area_group").cast("string"), F.lit("?")), F.lit("  page "),
        F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit("  n_inliers="),
        F.coalesce("n_inliers", F.lit(0)).cast("string"), F.lit("  road_name_agreement="),
        F.when(F.col("road_score").isNull(), "?").otherwise(road), verdict, F.lit("  scale_consistency="),
        F.when(F.col("scale_score").isNull(), "?").otherwise(scale),
        F.when(F.col("committed"), "  [COMMITTED]").otherwise(""),
    )
    return attempts.select("case_id", "seq", line.alias("line"))


def best_epochs(history: DataFrame, patience: int) -> DataFrame:
    """fold, best_epoch, best_val, epochs_since_best, stopped_at over the epochs actually run.

    `history` has fold, epoch, val, one row per epoch. Training stops after `patience` epochs
    without a new best value; of equal values the first epoch is the best.
    """
    kept = kept_epochs(history, patience)
    best = kept.groupBy("fold").agg(
        F.min_by("epoch", F.struct((-F.col("val")).alias("v"), "epoch")).alias("best_epoch"),
        F.max("val").alias("best_val"), F.max("epoch").alias("stopped_at"), F.max("since").alias("_s"),
        F.max_by("since", "epoch").alias("epochs_since_best"),
    )
    return best.drop("_s")


def kept_epochs(history: DataFrame, patience: int) -> DataFrame:
    """history plus best_so_far and since (epochs without improvement), cut at the first stop.

    A fold has as many rows as epochs were trained, so its windows stay small.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("fold").orderBy("epoch")
    before = F.max("val").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = history.withColumn("_new", (before.isNull() | (F.col("val") > before)).cast("int"))
    rows = rows.withColumn("_streak", F.sum("_new").over(order))
    since = F.row_number().over(Window.partitionBy("fold", "_streak").orderBy("epoch")) - 1
    rows = rows.withColumns({"since": since, "best_so_far": F.max("val").over(order)})
    stopped = F.max(F.when(F.col("since") >= patience, 1).otherwise(0)).over(
        order.rowsBetween(Window.unboundedPreceding, -1)
    )
    return rows.withColumn("_stop", stopped).where("coalesce(_stop, 0) = 0").drop("_new", "_streak", "_stop")
