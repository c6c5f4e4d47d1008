"""Which features can stand in for a selected one: substitution groups and structural groups of a fitted model.

Everything comes from the model's Gram matrix of unit profiles (features by features); no rows are read again and the
selection stays as it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import residual
from .selector import Model, ParameterError

GROUP_REPORT = "representative_index int, representative string, member_index int, member string, is_selected_representative boolean, cgs_similarity double"
STRUCTURAL_REPORT = """group_id string, selection_step int, representative_index int, representative string, n_members int, n_substitutes int, is_singleton boolean, members string,
representative_selection_score double, representative_effective_support double, representative_sample_coverage double, representative_residual_novelty double,
representative_adjusted_p_value double, mean_member_cgs_similarity double, min_member_cgs_similarity double, output_feature string"""


def similarities(h, selected: Sequence[int]) -> dict[int, list[float]]:
    """For each feature that is not selected, how well it can stand in for each selected one."""
    return {j: [residual.substitution(h, list(selected), r, j) for r in selected] for j in range(len(h)) if j not in selected}


@dataclass
class SubstitutionGroups:
    """Each feature that is not selected joins the selected one that it replaces best, if that reaches ``limit``."""

    model: Model
    limit: float = 0.85
    groups: dict[int, list[int]] = field(default_factory=dict)
    similarity: dict[int, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not 0 <= self.limit <= 1:
            raise ParameterError("limit must lie between 0 and 1")
        selected = self.model.selected
        self.groups = {r: [r] for r in selected}
        self.similarity = {r: 1.0 for r in selected}
        for j, found in similarities(self.model.geometry.gram, selected).items() if selected else ():
            best = int(np.argmax(found))
            if found[best] >= self.limit:
                self.groups[selected[best]].append(j)
                self.similarity[j] = found[best]
        for members in self.groups.values():
            members.sort()

    def named(self) -> dict[str, list[str]]:
        names = self.model.features
        return {names[r]: [names[j] for j in members] for r, members in self.groups.items()}

    def diagnostic(self) -> dict:
        """For a JSON report.  (Names of entries are those of the format.)"""
        return {"substitution_diagnostic": {"experimental": True, "threshold": self.limit, "groups": self.named(), "selection_changed_by_grouping": False}}

    def members(self, spark: SparkSession) -> DataFrame:
        """A row for each member of each group, the representative first, then by similarity."""
        names = self.model.features
        rows = [(r, names[r], j, names[j], j == r, float(self.similarity[j])) for r, members in self.groups.items() for j in members]
        return spark.createDataFrame(sorted(rows, key=lambda x: (x[0], not x[4], -x[5], x[2])), GROUP_REPORT)


@dataclass(frozen=True)
class StructuralGroup:
    group_id: str
    selection_step: int
    representative_index: int
    representative: str
    member_indices: list[int]
    members: list[str]
    n_members: int
    n_substitutes: int
    is_singleton: bool
    representative_selection_score: float
    representative_effective_support: float
    representative_sample_coverage: float
    representative_residual_novelty: float
    representative_adjusted_p_value: float
    mean_member_cgs_similarity: float
    min_member_cgs_similarity: float
    member_cgs_similarity: dict[str, float]
    output_feature: str


class StructuralGroups(SubstitutionGroups):
    """SG01, SG02, ... in the order of selection; a representative counts among its members with similarity 1."""

    def structural(self) -> list[StructuralGroup]:
        names, support, out = self.model.features, self.model.support, []
        for step in self.model.path:
            r = step["feature_index"]
            members = self.groups[r]
            found = [float(self.similarity[j]) for j in members]
            out.append(
                StructuralGroup(
                    f"SG{step['step']:02d}", step["step"], r, names[r], list(members), [names[j] for j in members], len(members), len(members) - 1, len(members) == 1,
                    float(step["selection_score"]), float(support.effective[r]), float(support.coverage[r]), float(step["residual_novelty"]), float(self.model.adjusted_p[r]),
                    float(np.mean(found)), min(found), dict(zip((names[j] for j in members), found, strict=True)), names[r],
                )
            )
        return out

    def diagnostic(self) -> dict:
        marks = {"experimental": True, "interpretive_only": True, "creates_latent_features": False, "selection_changed_by_grouping": False}
        return super().diagnostic() | {"structural_group_output": marks | {"summary": self.summary(), "groups": [asdict(g) for g in self.structural()]}}

    def report(self, spark: SparkSession) -> DataFrame:
        names = [x.split()[0] for x in STRUCTURAL_REPORT.replace("\n", " ").split(", ")]
        rows = [asdict(g) | {"members": " | ".join(g.members)} for g in self.structural()]
        return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], STRUCTURAL_REPORT)

    def feature_map(self, names: bool = True, unassigned: bool = True) -> dict:
        """Feature (name or index) to group_id; None for features in no group, which may be left out."""
        of = {j: g.group_id for g in self.structural() for j in g.member_indices}
        return {(c if names else j): of.get(j) for j, c in enumerate(self.model.features) if unassigned or j in of}

    def representatives(self, names: bool = True) -> list:
        return [self.model.features[j] if names else j for j in self.model.selected]

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        """The representatives' columns: no new feature is made."""
        return self.model.transform(df, *keep)

    def summary(self) -> dict:
        found = self.structural()
        return {
            "n_structural_groups": len(found),
            "n_non_singleton_groups": sum(not g.is_singleton for g in found),
            "n_grouped_original_features": sum(g.n_members for g in found),
            "n_contextual_substitutes": sum(g.n_substitutes for g in found),
            "n_selected_representatives": len(self.model.selected),
            "representative_output_dimension": len(self.model.selected),
            "creates_latent_features": False,
            "changes_selection": False,
            "substitution_threshold": float(self.limit),
        }
