"""Bundles of related tables with contracts checked on both ends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankloom.operators.contracts import ContractError, check_unique, require_columns, violations
from rankloom.sources.tables import read_table, write_table


@dataclass(frozen=True)
class TableContract:
    columns: tuple[str, ...]
    key: tuple[str, ...]
    rules: Mapping[str, Column] = field(default_factory=dict)


def check_table(df: DataFrame, contract: TableContract, label: str) -> None:
    """Columns, key and value rules; two small aggregate jobs per table."""
    require_columns(df, contract.columns, label)
    if not check_unique(df, contract.key).isEmpty():
        raise ContractError(f"{label}: key {contract.key} repeats")
    if contract.rules:
        # One row per rule.
        broken = [r["rule"] for r in violations(df, contract.rules).where("n_violations > 0").collect()]
        if broken:
            raise ContractError(f"{label}: broken rules {broken}")


def save_bundle(tables: Mapping[str, DataFrame], directory: str, contracts: Mapping[str, TableContract]) -> None:
    for name, contract in contracts.items():
        check_table(tables[name], contract, name)
    for name in contracts:
        write_table(tables[name], f"{directory}/{name}.parquet")


def load_bundle(spark: SparkSession, directory: str, contracts: Mapping[str, TableContract]) -> dict[str, DataFrame]:
    out = {name: read_table(spark, f"{directory}/{name}.parquet") for name in contracts}
    for name, contract in contracts.items():
        check_table(out[name], contract, name)
    return out


# Columns and keys of the engine's tables.
DOMAINS = TableContract(
    ("domain_id", "pdb_id", "chain_id", "sequence", "length", "cath_c", "cath_a", "cath_t", "cath_h", "dataset", "analysis_role", "eligible_for_training"),
    ("domain_id",),
)
RESIDUES = TableContract(("domain_id", "position", "residue", "is_resolved", "has_complete_backbone", "rsa", "burial", "contact_degree"), ("domain_id", "position"))
BENCHMARKS = TableContract(("benchmark_id", "domain_id", "dataset", "sequence", "pdb_id", "chain_id", "cath_t", "cath_h"), ("benchmark_id",))
HOMOLOGY = TableContract(("domain_id", "benchmark_id", "sequence_identity", "query_coverage", "target_coverage"), ("domain_id", "benchmark_id"))
STATES = TableContract(("state_id", "domain_id", "state_kind", "replicate", "reference_sequence", "state_sequence", "requested_corruption_ratio"), ("state_id",))
POSITIONS = TableContract(("state_id", "domain_id", "position", "native_aa", "current_aa", "is_corrupted", "is_masked"), ("state_id", "position"))
REQUESTS = TableContract(("request_id", "state_id", "domain_id", "state_sequence", "structure_role", "structure_id", "length"), ("request_id",))
SCORES = TableContract(
    ("state_id", "domain_id", "position", "teacher_id", "teacher_role", "structure_role", "structure_id", "logp"),
    ("state_id", "domain_id", "position", "teacher_id", "teacher_role", "structure_role", "structure_id"),
)
DECOYS = TableContract(("decoy_id", "domain_id", "decoy_role", "has_coordinates"), ("decoy_id",))
