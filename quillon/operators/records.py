"""Records with provenance: rankings made elsewhere, integrity records of data sets, fingerprints of matrices and files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import read_text, write_text
from . import rankers
from .governance import USED_LABELS, audit

SCHEMA_VERSION = 1


class RecordError(ValueError):
    """A record breaks a rule of its schema."""


def table_fingerprint(df: DataFrame, key: str, features: Sequence[str]) -> str:
    """SHA-256 over names, shape and an order-independent sum of the rows' hashes: a table of any size, no row on the driver.
    It is another value than ``array_fingerprint``'s."""
    row = F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), *(F.coalesce(F.hex(F.col(c).cast("double").cast("string")), F.lit("null")) for c in features)), 256)
    parts = [F.sum(F.conv(F.substring(row, 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    got = df.agg(F.count("*"), *parts).first()
    return hashlib.sha256(json.dumps([list(features), *(str(x) for x in got)]).encode()).hexdigest()


def array_fingerprint(x, names: Sequence[str] | None = None) -> str:
    """SHA-256 of shape, row-major doubles and names of a small array on the driver."""
    import numpy as np

    x = np.ascontiguousarray(np.asarray(x, dtype=np.float64))
    h = hashlib.sha256(str(tuple(x.shape)).encode())
    h.update(x.tobytes())
    if names is not None:
        h.update(json.dumps(list(map(str, names)), ensure_ascii=False, separators=(",", ":")).encode())
    return h.hexdigest()


# Rankings


def ranking_record(ranking: Sequence[int], method: str, dataset_id: str, source: str, used_y: bool = False, used_class_count: bool = False, version: str | None = None, commit: str | None = None, data_sha256: str | None = None, notes: str | None = None) -> dict:
    """Fixed field names: the exchange format of rankings."""
    record = {
        "schema_version": SCHEMA_VERSION, "method": method, "dataset_id": dataset_id, "feature_count": len(ranking), "indexing": "zero_based", "ranking": [int(j) for j in ranking],
        "selection_used_y": bool(used_y), "selection_used_ground_truth_class_count": bool(used_class_count), "source": {"name": source, "version": version, "commit": commit},
        "data_sha256": data_sha256, "notes": notes,
    }
    check_ranking_record(record, label_blind=False)
    return record


def check_ranking_record(record: dict, features: int | None = None, dataset_id: str | None = None, data_sha256: str | None = None, label_blind: bool = True) -> None:
    """Raises RecordError with the first rule that is broken."""
    if not isinstance(record, dict):
        raise RecordError("a record is a JSON object")
    n, ranking = record.get("feature_count", -1), record.get("ranking") or []
    source = record.get("source")
    rules = [
        (record.get("schema_version") == SCHEMA_VERSION, f"schema_version must be {SCHEMA_VERSION}"),
        (record.get("indexing") == "zero_based", "indexing must be zero_based"),
        (isinstance(n, int) and n >= 1, "feature_count must be a positive number"),
        (sorted(ranking) == list(range(max(n, 0))), "ranking must be a permutation of all features"),
        (features is None or n == features, f"feature_count must be {features}"),
        (dataset_id is None or str(record.get("dataset_id")) == dataset_id, "dataset_id is another one"),
        (data_sha256 is None or str(record.get("data_sha256")) == data_sha256, "data_sha256 is another one"),
        (isinstance(source, dict) and str(source.get("name") or "").strip() != "", "source.name is needed"),
        (not label_blind or record.get("selection_used_y") is False, "selection_used_y must be false"),
        (not label_blind or record.get("selection_used_ground_truth_class_count") is False, "selection_used_ground_truth_class_count must be false"),
    ]
    for good, message in rules:
        if not good:
            raise RecordError(message)


def ranking_faults(records: DataFrame, label_blind: bool = True) -> DataFrame:
    """With ``fault`` (null: valid) for a table of records: the same rules as columns."""
    n, ranking = F.col("feature_count"), F.col("ranking")
    whole = F.array_sort(ranking) == F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    rules: list[tuple[Column, str]] = [
        (F.col("schema_version") == SCHEMA_VERSION, "schema_version"), (F.col("indexing") == "zero_based", "indexing"), (n >= 1, "feature_count"),
        (whole, "ranking"), (F.trim(F.col("source.name")) != "", "source"),
    ]
    if label_blind:
        rules += [(~F.col("selection_used_y"), "selection_used_y"), (~F.col("selection_used_ground_truth_class_count"), "class_count")]
    return records.withColumn("fault", F.coalesce(*(F.when(~F.coalesce(good, F.lit(False)), name) for good, name in rules)))


def write_ranking_record(spark: SparkSession, record: dict, path: str) -> str:
    check_ranking_record(record, label_blind=False)
    return write_text(spark, path, json.dumps(record, indent=2, sort_keys=True))


def read_ranking_record(spark: SparkSession, path: str, **expected) -> dict:
    record = json.loads(read_text(spark, path))
    check_ranking_record(record, **expected)
    return record


def ranking_from_record(record: dict, features: Sequence[str], k: int) -> rankers.Ranking:
    """Its source is author_code:NAME, with @COMMIT if that is known."""
    source = record["source"]
    return rankers.external_ranking(features, record["ranking"], k, f"author_code:{source['name']}" + (f"@{source['commit']}" if source.get("commit") else ""))


# Integrity of data sets


@dataclass(frozen=True)
class IntegrityRecord:
    """Fixed field names: where a data set comes from and what its preparation saw."""

    dataset: str
    source_uri: str
    source_kind: str = "official_or_raw"
    raw_dataset_id: str | None = None
    target_name: str | None = None
    source_sha256: str | None = None
    row_sampling_used_y: bool = False
    feature_filtering_used_y: bool = False
    preprocessing_used_y: bool = False
    imputation_used_y: bool = False
    scaling_used_y: bool = False
    encoding_used_y: bool = False
    dimension_reduction_used_y: bool = False
    provenance_complete: bool = True
    raw_feature_space_preserved: bool = True
    notes: str = ""


RECORD_SCHEMA = ", ".join(f"{f.name} {'boolean' if 'bool' in str(f.type) else 'string'}" for f in fields(IntegrityRecord))


def integrity_frame(spark: SparkSession, records: Sequence[IntegrityRecord | dict]) -> DataFrame:
    """Of records or dictionaries; a dictionary that leaves out raw_feature_space_preserved has it, one that leaves out
    provenance_complete has not."""
    rows, left_out = [], {"raw_feature_space_preserved": True, "notes": ""}
    for r in records:
        if not isinstance(r, (IntegrityRecord, dict)):
            raise TypeError("a record is an IntegrityRecord or a dictionary")
        r = asdict(r) if isinstance(r, IntegrityRecord) else r
        rows.append(tuple(r.get(f.name, left_out.get(f.name)) for f in fields(IntegrityRecord)))
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def read_manifest(spark: SparkSession, source) -> DataFrame:
    """A manifest: a DataFrame, a JSON file (a list, or an object with ``records``), a CSV file, a dictionary or records."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str) and source.lower().endswith(".json"):
        source = json.loads(read_text(spark, source))
    if isinstance(source, str):
        df = spark.read.csv(source, header=True)
        return df.select(*(F.expr(f"try_cast(`{c}` AS BOOLEAN)").alias(c) if c in (*USED_LABELS, "provenance_complete", "raw_feature_space_preserved") else F.col(c) for c in df.columns))
    if isinstance(source, dict):
        source = source.get("records", [source])
    return integrity_frame(spark, list(source))


def audit_manifest(records: DataFrame) -> dict:
    """n_records, counts by status, eligible data sets (a short list) and the audited table."""
    audited = audit(records)
    counts = {r.status: r.n for r in audited.groupBy("status").agg(F.count("*").alias("n")).collect()}
    eligible = sorted(r.dataset for r in audited.where("eligible").select("dataset").distinct().collect())
    return {"schema_version": 1, "n_records": sum(counts.values()), "counts": {s: counts.get(s, 0) for s in ("PASS", "FAIL", "REVIEW")}, "eligible_datasets": eligible, "records": audited}


def write_audit(spark: SparkSession, found: dict, path: str) -> str:
    """JSON with sorted keys; the audited rows as a list."""
    rows = [json.loads(r) for r in found["records"].toJSON().collect()]  # records of data sets: a short table
    return write_text(spark, path, json.dumps(found | {"records": rows}, indent=2, sort_keys=True))
