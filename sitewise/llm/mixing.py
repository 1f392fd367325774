"""Time-varying curriculum: weight schedules of sources turned into training positions of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.llm.common import content_key, fresh, settle
from sitewise.operators.stats import bucketed_rank

CAP = 3  # a source is repeated this many times at most
PART_BITS = 12  # hash prefixes a source is divided into for running totals
# Knots (time, weight) of three schedules; their means are 1, 2 and 3.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 2.5), (0.5, 3.0), (1.0, 3.5)))


def _segments(schedules) -> list[list[tuple[float, float, float, float, float]]]:
    """Per schedule (from, to, weight at from, slope, mass before), mass being the integral of the weight."""
    out = []
    for knots in schedules:
        mass, rows = 0.0, []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            rows.append((t0, t1, w0, (w1 - w0) / (t1 - t0), mass))
            mass += (t1 - t0) * (w0 + w1) / 2
        out.append([*rows, (1.0, 1.0, 0.0, 0.0, mass)])
    return out


def schedule_mass(schedules) -> list[float]:
    """The integral of each schedule's weight over all of training: its source's weight in the mix."""
    return [rows[-1][4] for rows in _segments(schedules)]


def _inverse(kind: Column, fraction: Column, schedules) -> Column:
    """Time at which a schedule has asked for `fraction` of what it asks for in all."""
    time = F.lit(None).cast("double")
    for i, rows in enumerate(_segments(schedules)):
        wanted = fraction * rows[-1][4]
        here = F.lit(1.0)
        for (t0, _, w0, slope, mass), (*_, upto) in reversed(list(zip(rows, rows[1:], strict=False))):
            more = F.greatest(wanted - mass, F.lit(0.0))
            if slope:
                into = (F.sqrt(F.greatest(w0 * w0 + 2 * slope * more, F.lit(0.0))) - w0) / slope
            else:
                into = more / w0 if w0 else F.lit(0.0)
            here = F.when(wanted < upto, t0 + into).otherwise(here)
        time = F.when(kind == i, here).otherwise(time)
    return time


def source_targets(sizes: DataFrame, schedules=SCHEDULES, cap: int = CAP) -> DataFrame:
    """(source, source_size, kind, target) of (source, source_size).

    Sources in code-point order, null last, take the schedules in turn. They share all words by the
    integral of their schedule; a target stops at `cap` times its source, and the excess goes to
    the others by weight until none is above. Only three sums per round reach the driver.
    """
    ranked = bucketed_rank(
        sizes.withColumn("_last", F.col("source").isNull().cast("int")), [],
        [F.col("_last"), F.col("source")], F.struct("_last", F.substring(F.coalesce("source", F.lit("")), 1, 6)), "_rank",
    )
    masses = F.array(*[F.lit(m) for m in schedule_mass(schedules)])
    table = settle(
        ranked.withColumn("kind", ((F.col("_rank") - 1) % len(schedules)).cast("int"))
        .select("source", "source_size", "kind", F.get(masses, F.col("kind")).alias("weight"))
    )
    size, weight = F.col("source_size"), F.col("weight")
    capped, level = -1, 0.0
    while True:
        full = cap * size < level * weight
        row = table.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, cap * size).otherwise(0)).alias("spent"),
            F.sum(F.when(full, 0.0).otherwise(weight)).alias("left"), F.count_if(full).alias("n"),
        ).first()
        if not row["all"] or row["n"] == capped:
            break
        capped = row["n"]
        level = (row["all"] - row["spent"]) / row["left"]
    return table.select("source", "source_size", "kind", F.least((cap * size).cast("double"), level * weight).alias("target"))


def mix(
    docs: DataFrame, size: Column, schedules=SCHEDULES, cap: int = CAP,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """docs with size, source_size, target, repeats, taken and positions.

    A source repeats whole passes over its documents and then, in hash order, those whose middle
    lies before the words still wanted: the words taken miss the target by half of one document at
    most, and no document is taken more than `cap` times. positions (0 to 1) are the training times, one
    for each time the document is taken, at which the source's cumulative demand reaches its middle
    in that pass; none for a document that isn't taken. Documents without words count 0 and follow the same rule. Null
    sources are one source. Equal rows may swap. Input columns of these names are replaced; an
    empty table gives no rows. Running totals go through hash prefixes of a source, so a source
    with a third of all rows is spread over 2^12 windows.
    """
    docs = docs.drop("size", "source_size", "target", "repeats", "taken", "positions")
    k, s, part, missing, name, before, start, kind = fresh(
        docs, "_key", "_words", "_part", "_missing", "_name", "_before", "_start", "_kind"
    )
    source = F.col(source_col)
    rows = docs.withColumns({
        k: content_key(F.col(id_col), F.col(text_col)), s: size, missing: source.isNull(),
        name: F.coalesce(source.cast("string"), F.lit("")),
    }).withColumn(part, F.shiftright(F.col(k), 60 - PART_BITS))
    parts = settle(rows.groupBy(missing, name, part).agg(F.sum(s).alias("_sum")))
    sums = parts.groupBy(missing, name).agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(
        sums.select(F.when(~F.col(missing), F.col(name)).alias("source"), "source_size"), schedules, cap
    ).select(F.col("source").isNull().alias(missing), F.coalesce("source", F.lit("")).alias(name), "source_size", F.col("kind").alias(kind), "target")
    upto = Window.partitionBy(missing, name).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(missing, name, part, F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias(start)).join(
        targets, [missing, name]
    )
    starts = settle(starts)
    inside = Window.partitionBy(missing, name, part).orderBy(k, id_col).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(before, F.sum(s).over(inside) - F.col(s)).join(starts, [missing, name, part])
    whole, total, target = F.col(s), F.col("source_size"), F.col("target")
    middle = F.col(before) + F.col(start) + whole / 2
    passes = F.when(total > 0, F.floor(target / total)).otherwise(0)
    rest = target - passes * total
    again = ((rest > 0) & (middle <= rest)).cast("bigint")

    def at(done: Column) -> Column:
        return _inverse(F.col(kind), F.least((done * total + middle) / target, F.lit(1.0)), schedules)

    times = F.transform(F.sequence(F.lit(0), (F.col("repeats") - 1).cast("int")), at)
    return rows.withColumns({"repeats": passes + again}).select(
        *docs.columns, whole.alias("size"), "source_size", "target", "repeats", (F.col("repeats") * whole).alias("taken"),
        F.when((F.col("repeats") > 0) & (target > 0), times).otherwise(F.array().cast("array<double>")).alias("positions"),
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """The taken documents, one row for each time they are taken, range-sorted by position (a column)."""
    taken = mixed.where("repeats > 0").withColumn("position", F.explode("positions"))
    return taken.drop("positions").orderBy("position")
