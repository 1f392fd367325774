"""Report sections by name: each takes its inputs and gives one lazy table, or is skipped."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.evaluate import scores as sc

Inputs = Mapping[str, Callable[[], DataFrame]]


def main_results(inputs: Inputs) -> DataFrame:
    """Headline row before and after the revision; needs `cases` and `spans`."""
    joined = inputs["cases"]().join(inputs["spans"](), "case_id")
    iou, err = sc.worker_first()
    first = joined.select(F.lit("first").alias("method"), iou.alias("iou"), err.alias("distance"), F.col("span_m").alias("span"))
    last = joined.select(F.lit("revised").alias("method"), "iou", F.col("err_m").alias("distance"), F.col("span_m").alias("span"))
    return sc.headline(first.unionByName(last), ["method"])


def located(inputs: Inputs) -> DataFrame:
    return sc.distance_summary(inputs["picks"](), ["method"], "err_m")


def folds(inputs: Inputs) -> DataFrame:
    return sc.fold_table(inputs["page_scores"](), ["iou", "f1"])


def methods(inputs: Inputs) -> DataFrame:
    return sc.method_comparison(inputs["method_pages"]())


def attributes(inputs: Inputs) -> DataFrame:
    return sc.attribute_breakdown(inputs["labels"](), inputs["scores"]())


REGISTRY: dict[str, Callable[[Inputs], DataFrame]] = {
    "main": main_results, "located": located, "folds": folds, "methods": methods, "attributes": attributes,
}


def sections(names: list[str], inputs: Inputs) -> dict[str, DataFrame | None]:
    """Tables by section; None where an input is not there. An unknown name is an error."""
    unknown = [n for n in names if n not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown section(s) {unknown}; choose from {sorted(REGISTRY)}")
    out: dict[str, DataFrame | None] = {}
    for name in names:
        try:
            out[name] = REGISTRY[name](inputs)
        except (KeyError, AnalysisException) as error:
            if isinstance(error, AnalysisException) and error.getCondition() != "PATH_NOT_FOUND":
                raise
            out[name] = None
    return out
