"""Gates on claims: what evidence a results table must show before a method may be called usable or better.

Each check is a small aggregate over the results; a report is a dictionary that can be written as JSON."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranks, results

CHECKS = "name string, passed boolean, observed string, required string"


@dataclass(frozen=True)
class PublicationGate:
    min_datasets: int = 30
    min_competitors: int = 3
    min_canonical_or_author_methods: int = 2
    max_method_failure_fraction: float = 0.20
    candidate_method: str = "geometry"
    require_source_integrity: bool = True


@dataclass(frozen=True)
class SuperiorityGate:
    metric: str = "balanced_accuracy"
    alpha: float = 0.05
    min_complete_datasets: int = 25
    min_significant_canonical_wins: int = 1
    candidate_method: str = "geometry"
    require_best_mean_rank: bool = True
    require_significant_omnibus: bool = True


def _check(name: str, passed, observed, required, **more) -> dict:
    return {"name": name, "passed": bool(passed), "observed": observed, "required": required} | more


def _report(config, checks: list[dict], **more) -> dict:
    passed = all(c["passed"] for c in checks)
    said = "evidence is sufficient; effect sizes and scope still bound what may be said" if passed else "evidence is not sufficient: claim neither superiority nor replacement"
    return {"schema_version": 1, "passed": passed, "config": asdict(config), "checks": checks, "claim_guidance": said} | more


def _columns(df: DataFrame, *names: str) -> None:
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"results have no columns {missing}")


def publication_gate(df: DataFrame | str, config: PublicationGate = PublicationGate(), audits: DataFrame | None = None, label_audit: DataFrame | None = None, frozen: bool = True, locked: bool = True) -> dict:
    """df: results, or the path of a CSV file of them.  ``audits``: dataset, eligible; ``label_audit``: method, all_trials_identical (see stability.audit_summary)."""
    df = results.results_of(df)
    _columns(df, "dataset", "method")
    df = df.withColumns({c: F.col(c).cast("string") for c in ("dataset", "method")})
    good = results.successful(df)
    own = good.where(F.col("method") == config.candidate_method)
    eligible = None
    if audits is not None:
        eligible = audits.where("eligible").agg(F.count_distinct("dataset")).first()[0]
        own = results.eligible_rows(own, audits)
    others = good.where(F.col("method") != config.candidate_method)
    canonical = results.canonical_methods(others).count()
    worst = results.failure_fractions(df).agg(F.max("fraction")).first()[0] or 0.0 if "error" in df.columns else 0.0
    blind = False
    if label_audit is not None and {"method", "all_trials_identical"} <= set(label_audit.columns):
        blind = bool(label_audit.where(F.col("method").cast("string") == config.candidate_method).agg(F.bool_and("all_trials_identical")).first()[0])
    datasets, competitors = own.agg(F.count_distinct("dataset")).first()[0], others.agg(F.count_distinct("method")).first()[0]
    checks = [
        _check("dataset_source_integrity_audit", eligible > 0 if eligible is not None else not config.require_source_integrity, eligible or 0, "audited PASS sources" if config.require_source_integrity else "optional"),
        _check("minimum_external_datasets", datasets >= config.min_datasets, datasets, config.min_datasets),
        _check("minimum_competitors", competitors >= config.min_competitors, competitors, config.min_competitors),
        _check("canonical_or_author_code_competitors", canonical >= config.min_canonical_or_author_methods, canonical, config.min_canonical_or_author_methods),
        _check("method_failure_fraction", worst <= config.max_method_failure_fraction, float(worst), f"<= {config.max_method_failure_fraction}"),
        _check("candidate_label_blindness_audit", blind, blind, True),
        _check("hyperparameters_frozen_before_external_benchmark", frozen, bool(frozen), True),
        _check("canonical_source_lock_present", locked, bool(locked), True),
    ]
    return _report(config, checks)


def superiority_gate(df: DataFrame | str, config: SuperiorityGate = SuperiorityGate(), evidence: dict | None = None) -> dict:
    """``evidence``: a report of the publication gate.  Only canonical or author-code competitors count as wins and losses;
    who is one is read from all rows, failed ones included."""
    df = results.results_of(df)
    _columns(df, "dataset", "method", config.metric)
    found = ranks.compare_methods(df, "dataset", "method", config.metric, config.candidate_method, alpha=config.alpha)
    mean_ranks = sorted(found["mean_ranks"].collect(), key=lambda r: (r.mean_rank, r.method))
    own = next((r.mean_rank for r in mean_ranks if r.method == config.candidate_method), None)
    if own is None:
        raise ValueError(f"{config.candidate_method} is in no complete comparison")
    best, p = mean_ranks[0].mean_rank, found["omnibus"]["p"]
    canonical = {r.method for r in results.canonical_methods(df).collect()}  # a row for each method
    post = []
    for row in found["posthoc"]:
        counts = row["method"] in canonical and row["significant_holm"]
        post.append(row | {"canonical_competitor": row["method"] in canonical, "significant_win": counts and row["mean_difference"] > 0, "significant_loss": counts and row["mean_difference"] < 0})
    wins, losses = sum(r["significant_win"] for r in post), sum(r["significant_loss"] for r in post)
    ok = True if evidence is None else bool(evidence.get("passed", False))
    complete = found["omnibus"]["n"]
    checks = [
        _check("minimum_evidence_publication_gate", ok, ok, True),
        _check("minimum_complete_datasets_for_superiority", complete >= config.min_complete_datasets, complete, config.min_complete_datasets),
        _check("significant_friedman_omnibus", p is not None and p < config.alpha or not config.require_significant_omnibus, p, f"p < {config.alpha}" if config.require_significant_omnibus else "optional"),
        _check("candidate_best_mean_rank", own <= best + 1e-8 + 1e-5 * abs(best) or not config.require_best_mean_rank, own, "best mean rank" if config.require_best_mean_rank else "optional", best_observed=best),
        _check("holm_significant_canonical_wins", wins >= config.min_significant_canonical_wins, wins, config.min_significant_canonical_wins),
        _check("no_holm_significant_canonical_losses", losses == 0, losses, 0),
    ]
    return _report(config, checks, metric=config.metric, mean_ranks=[{"method": r.method, "mean_rank": r.mean_rank} for r in mean_ranks], posthoc=post)


def suite_gate(raw: DataFrame, manifest: DataFrame, audits: DataFrame, min_tasks: int = 30) -> dict:
    """A suite counts the tasks that ran (manifest: task_id, status) and whose data set, named task<id>_..., passed its
    audit; no method may have failed (raw: method, error)."""
    accepted = manifest.where("status = 'ok'").select(F.col("task_id").cast("long").alias("task_id")).distinct()
    audited = audits.where("eligible").select(F.expr(r"try_cast(regexp_extract(dataset, '^task([0-9]+)(_|$)', 1) AS BIGINT)").alias("task_id")).where("task_id is not null").distinct()
    n, counted = accepted.count(), accepted.intersect(audited).count()
    bad = results.failed(raw)
    methods = sorted(r.method for r in raw.where(~bad).select("method").distinct().collect())
    canonical, failures = [m for m in methods if "scikit-feature" in m], raw.where(bad).count()
    checks = {"task_count": counted >= min_tasks, "canonical_comparators": len(canonical) >= 2, "zero_method_failures": failures == 0, "source_integrity": counted == n and counted >= min_tasks}
    return {"minimum_tasks_required": min_tasks, "accepted_ok_tasks": n, "source_integrity_pass_tasks": counted, "methods": methods, "canonical_methods": canonical, "method_failure_rows": failures, "checks": checks, "overall_pass": all(checks.values())}


def frame(spark: SparkSession, report: dict) -> DataFrame:
    """A row for each check."""
    text = lambda x: str(x).lower() if isinstance(x, bool) else f"{x:.6f}" if isinstance(x, float) else str(x)
    return spark.createDataFrame([(c["name"], c["passed"], text(c["observed"]), text(c["required"])) for c in report["checks"]], CHECKS)
