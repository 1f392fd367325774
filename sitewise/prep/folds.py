"""Fold assignment, routing and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.functions import text as tx
from sitewise.operators.stats import bucketed_rank

# Members of hand-made groups that must stay in one fold, by their group's first case.
EXPLICIT_GROUPS = (
    ("12:00141:ART4", "12:00117:ART4"),
    (
        "095AB379-F04E-473A-BC0D-8948B58E4090", "3DA282A7-E829-47CF-B842-E03E0C704072",
        "4AB36890-E52B-4CCC-9CDE-FB1476FCEB82", "B9CDCF90-EC6A-4B66-A967-DEBF3B72D58D",
        "DE5A30DA-29A4-45BE-B60A-C201A5F11C6F", "FDBC0FDC-D090-4778-A123-232EB71DF3C6",
    ),
)


def explicit_groups(spark) -> DataFrame:
    """case_id, group_key of the hand-made groups: a few rows."""
    rows = [(member, group[0]) for group in EXPLICIT_GROUPS for member in group]
    return spark.createDataFrame(rows, "case_id string, group_key string")


def with_group_key(cases: DataFrame, explicit: DataFrame) -> DataFrame:
    """Add group_key: the explicit group where there is one, else the name without its page."""
    named = explicit.select("case_id", F.col("group_key").alias("_g"))
    joined = cases.join(F.broadcast(named), "case_id", "left")
    return joined.withColumn("group_key", F.coalesce("_g", tx.page_case(F.col("case_id")))).drop("_g")


def _phases(histogram: list[tuple[int, int]], n_folds: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first index, last index, cycle): fold = cycle[(index - first) mod length].

    Groups of one size go one by one to the smallest fold. Between two load levels the folds below
    take turns in a fixed cycle, so each size needs at most a few cycles however many groups it has.
    """
    loads = [0] * n_folds
    out = []
    for size, n in sorted(histogram, reverse=True):
        done = 0
        while done < n:
            order = sorted(range(n_folds), key=lambda f: (loads[f], f))
            first = loads[order[0]]
            # Folds that take a turn before the first one is up again.
            turn = [f for f in order if (loads[f], f) < (first + size, order[0])]
            # Full rounds until the next waiting fold would be chosen first.
            waiting = [f for f in order if f not in turn]
            rounds = n - done
            if waiting:
                rounds = max(1, (loads[waiting[0]] - max(loads[f] for f in turn)) // size)
            take = min(n - done, rounds * len(turn))
            out.append((size, done, done + take - 1, turn))
            for i, f in enumerate(turn):
                loads[f] += size * (take // len(turn) + (1 if i < take % len(turn) else 0))
            done += take
    return out


def balanced_folds(cases: DataFrame, n_folds: int = 5, prefix: int = 4) -> DataFrame:
    """group_key, n_members, fold: largest groups first, each to the smallest fold, exactly greedy.

    Only the histogram of group sizes comes to the driver: d distinct sizes need at least d(d+1)/2
    cases, so it has at most sqrt(2N) rows. Groups of a size are ranked in key order by Spark, in
    key-prefix buckets.
    """
    groups = cases.groupBy("group_key").agg(F.count("*").alias("n_members"))
    histogram = [(r["n_members"], r["n"]) for r in groups.groupBy("n_members").agg(F.count("*").alias("n")).collect()]
    phases = cases.sparkSession.createDataFrame(
        _phases(histogram, n_folds), "n_members bigint, _from bigint, _to bigint, _cycle array<int>"
    )
    ranked = bucketed_rank(
        groups, ["n_members"], [F.col("group_key")], F.left("group_key", F.lit(prefix)), "_i"
    ).withColumn("_i", F.col("_i") - 1)
    joined = ranked.join(phases, "n_members").where("_i BETWEEN _from AND _to")
    fold = F.element_at("_cycle", ((F.col("_i") - F.col("_from")) % F.size("_cycle") + 1).cast("int"))
    return joined.select("group_key", "n_members", fold.alias("fold"))


def route_folds(cases: DataFrame, fold_map: DataFrame, available: list[int]) -> DataFrame:
    """Add fold by routing key; unknown cases and folds that are not available get the smallest."""
    keyed = fold_map.groupBy(tx.route_key(F.col("case_id")).alias("_k")).agg(F.max("fold").alias("_f"))
    joined = cases.withColumn("_k", tx.route_key(F.col("case_id"))).join(keyed, "_k", "left")
    known = F.col("_f").isin(*available)
    return joined.withColumn("fold", F.when(known, F.col("_f")).otherwise(min(available)).cast("int")).drop("_k", "_f")


def manifest(files: DataFrame, fold_map: DataFrame) -> DataFrame:
    """case_id, filename, fold of files that belong to a case of the fold map."""
    keyed = fold_map.withColumn("_k", tx.route_key(F.col("case_id")))
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    return files.withColumn("_k", tx.route_key(stem)).join(keyed, "_k").select("case_id", "filename", "fold")


def complete_cases(files: DataFrame, required: tuple[str, ...] = ("map.png", "edited_mask.png")) -> DataFrame:
    """case_id, complete, reason: a case needs every required file, the first missing one is named."""
    flags = files.groupBy("case_id").agg(*[F.max(F.col("filename") == r).alias(f"_{i}") for i, r in enumerate(required)])
    reason = F.coalesce(*[F.when(~F.col(f"_{i}"), F.lit(f"missing {r}")) for i, r in enumerate(required)])
    return flags.select("case_id", reason.isNull().alias("complete"), reason.alias("reason"))


def fold_splits(rows: DataFrame, n_folds: int = 5, oversample: int = 2) -> DataFrame:
    """Rows per (split_fold, split): training rows `oversample` times, held-out rows once."""
    folds = F.explode(F.array(*[F.lit(f) for f in range(n_folds)]))
    each = rows.withColumn("split_fold", folds)
    held = F.col("split_fold") == F.col("fold")
    each = each.withColumn("split", F.when(held, "valid").otherwise("train"))
    return each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(held, 1).otherwise(oversample))))


def rotation_samples(labels: DataFrame) -> DataFrame:
    """Four rows per label: applied turn and the turn that is still needed after it."""
    turned = labels.withColumn("applied", F.explode(F.array(*[F.lit(a) for a in (0, 90, 180, 270)])))
    return turned.withColumn("label", F.pmod(F.col("degrees") - F.col("applied"), F.lit(360)).cast("int"))


def rotation_labels(raw: DataFrame) -> DataFrame:
    """case_id, degrees from a key/value label map: bookkeeping keys and skips are dropped."""
    degrees = F.col("value").try_cast("int")
    return raw.where(~F.startswith("key", F.lit("__")) & degrees.isin(0, 90, 180, 270)).select(
        F.col("key").alias("case_id"), degrees.alias("degrees")
    )
