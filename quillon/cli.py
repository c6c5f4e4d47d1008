"""Command line: read a matrix, select columns, write them and a report.

    python -m quillon.cli INPUT [--output PATH] [--report FILE] [options]

A report is the model's own (``Model.summary``), with that of its groups where they are asked for."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .operators.groups import StructuralGroups, SubstitutionGroups
from .operators.selector import GeometrySelector
from .sources.files import write_report
from .sources.formats import read_matrix, write_matrix


def count_or_auto(text: str) -> int | str:
    """A positive number or "auto"."""
    value = "auto" if text.lower() == "auto" else int(text) if text.isdigit() else 0
    if not value:
        raise argparse.ArgumentTypeError("a positive number or auto is needed")
    return value


#: Options of the estimator: its field and how the command line reads it.
ESTIMATOR = {
    "--alpha": ("alpha", {"type": float}),
    "--max-pairs": ("max_pairs", {"type": int}),
    "--n-features": ("n_features", {"type": count_or_auto}),
    "--pair-sampler": ("pair_sampling", {"choices": ("balanced", "random")}),
    "--permutations": ("n_permutations", {"type": int}),
    "--seed": ("seed", {"type": int}),
}
#: Where data come from and go to, and what is reported beside the selection.
FLOW = {
    "--diagnose-substitutes": {"action": "store_true", "help": "add groups of substitutes to the report"},
    "--exclude-columns": {"default": "", "help": "columns left out, separated by commas"},
    "--key": {"help": "a unique column that names the rows; else rows are numbered as they are read"},
    "--output": {"help": "selected columns: a folder of csv or parquet files, or one .npy file"},
    "--report": {"help": "JSON report"},
    "--structural-groups": {"action": "store_true", "help": "add structural groups to the report"},
    "--substitution-threshold": {"type": float, "default": 0.85},
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillon", description="Select columns of a numeric matrix without labels.")
    p.add_argument("input", help=".csv or .npy matrix, or a folder of parquet files")
    for option, (field, how) in ESTIMATOR.items():
        p.add_argument(option, dest=field, default=getattr(GeometrySelector, field), **how)
    for option, how in FLOW.items():
        p.add_argument(option, **how)
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Prints the report as one line of JSON and returns it."""
    asked = vars(parser().parse_args(argv))
    spark = spark or SparkSession.builder.appName("quillon").getOrCreate()
    left_out = [c for c in map(str.strip, asked["exclude_columns"].split(",")) if c]
    df, key = read_matrix(spark, asked["input"], left_out, asked["key"])
    model = GeometrySelector(**{field: asked[field] for field, _ in ESTIMATOR.values()}).fit(df, key)
    report = {"input": asked["input"]} | model.summary()
    kind = StructuralGroups if asked["structural_groups"] else SubstitutionGroups if asked["diagnose_substitutes"] else None
    if kind:
        report |= kind(model, asked["substitution_threshold"]).diagnostic()
    if asked["output"]:
        write_matrix(model.transform(df, key), key, model.get_feature_names_out(), asked["output"], asked["input"])
    if asked["report"]:
        write_report(spark, report, asked["report"])
    print(json.dumps(report, sort_keys=True))
    return report


if __name__ == "__main__":
    main()
