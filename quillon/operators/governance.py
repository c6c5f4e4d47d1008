"""Audits of where data sets and implementations come from, as column predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Flags of an integrity record that say whether a step before selection saw the target.
USED_LABELS = (
    "row_sampling_used_y",
    "feature_filtering_used_y",
    "preprocessing_used_y",
    "imputation_used_y",
    "scaling_used_y",
    "encoding_used_y",
    "dimension_reduction_used_y",
)


def implementation_kind(source: Column) -> Column:
    """author_code, canonical or native_or_local; null is native_or_local."""
    s = F.lower(source)
    canonical = s.contains("scikit-feature") | s.startswith("canonical:")
    return F.when(s.contains("author"), "author_code").when(canonical, "canonical").otherwise("native_or_local")


def audit(records: DataFrame) -> DataFrame:
    """With ``status``, ``eligible`` and ``reasons``.

    FAIL: a step used the target, or the raw features are gone.  Else REVIEW: provenance or source_uri is missing.
    Else PASS.  A null flag is false, so a null raw_feature_space_preserved fails; without its column a flag is false,
    raw_feature_space_preserved true and provenance_complete false."""
    has = lambda c, default: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in records.columns else F.lit(default)
    used = [has(c, False) for c in USED_LABELS]
    raw, complete = has("raw_feature_space_preserved", True), has("provenance_complete", False)
    uri = F.trim(F.coalesce(F.col("source_uri") if "source_uri" in records.columns else F.lit(""), F.lit("")))
    reasons = [
        *(F.when(u, F.lit(f"{c} is set")) for c, u in zip(USED_LABELS, used, strict=True)),
        F.when(~raw, F.lit("raw features are not preserved")),
        F.when(~complete, F.lit("provenance is incomplete")),
        F.when(uri == "", F.lit("source_uri is missing")),
    ]
    status = F.when(F.greatest(*used, ~raw), "FAIL").when(~complete | (uri == ""), "REVIEW").otherwise("PASS")
    return records.withColumns({"status": status, "eligible": status == "PASS", "reasons": F.array_compact(F.array(*reasons))})
