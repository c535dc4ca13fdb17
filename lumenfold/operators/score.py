"""Structural evidence, backbone confidence, recommendations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.metadata import confidence_level, structure
from ..functions.peaks import finite

KEYS = ["method", "query_index", "cluster"]
#: Weights of the parts of the score; cluster size that counts as full support; atoms that count as coverage; least score.
SUPPORT, OVERLAP, COVERAGE, EXACT = 0.30, 0.35, 0.25, 0.10
FULL, ATOMS, PASS = 100.0, 5, 0.40


def confidence_table(evidence: DataFrame) -> DataFrame:
    """One row per cluster, renamed for scoring; of repeated rows the one with most molecules, then its strings."""
    order = Window.partitionBy(*KEYS).orderBy(F.desc("n_molecules"), "scaffold_smiles", "smarts")
    one = evidence.where("cluster is not null").withColumn("k", F.row_number().over(order)).where("k = 1")
    return one.select(*KEYS, F.col("smarts").alias("cluster_smarts"), F.col("scaffold_smiles").alias("cluster_scaffold"), "n_molecules", F.col("confidence").alias("cluster_confidence"), "mcs_num_atoms", "mcs_num_bonds")


def _clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def backbone_confidence(neighbors: DataFrame, evidence: DataFrame | None) -> DataFrame:
    """Adds support, overlap, coverage, exact, backbone_confidence, confidence_level, passes, reason.

    neighbors: keys, candidate_scaffold, candidate_scaffold_atoms. Clusters without evidence score 0. Without any
    evidence table the cluster's size alone gives at most 0.30, so nothing passes.
    """
    if evidence is None:
        size = F.count("*").over(Window.partitionBy(*KEYS))
        rows = neighbors.withColumns({"support": F.least(F.lit(1.0), size / FULL), "overlap": F.lit(0.0), "coverage": F.lit(0), "exact": F.lit(0)})
        rows = rows.withColumn("backbone_confidence", SUPPORT * F.col("support")).withColumn("reason", F.lit("cluster_size_only_no_mcs"))
    else:
        rows = neighbors.join(confidence_table(evidence), KEYS, "left")
        own = F.col("cluster_confidence").cast("double")
        atoms, molecules = F.coalesce("mcs_num_atoms", F.lit(0)), F.coalesce("n_molecules", F.lit(0))
        a, b = structure(F.col("candidate_scaffold")), structure(F.col("cluster_scaffold"))
        rows = rows.withColumns(
            {
                "support": _clip(F.when(finite(own) & (own > 0), own).otherwise(F.least(F.lit(1.0), molecules / FULL))),
                "overlap": _clip(atoms / F.greatest(F.coalesce("candidate_scaffold_atoms", F.lit(0)), F.lit(1))),
                "coverage": F.when(atoms >= ATOMS, 1).otherwise(0),
                "exact": F.when((a == b) & (a != ""), 1).otherwise(0),
            }
        )
        score = _clip(SUPPORT * F.col("support") + OVERLAP * F.col("overlap") + COVERAGE * F.col("coverage") + EXACT * F.col("exact"))
        rows = rows.withColumn("backbone_confidence", F.when(atoms <= 0, 0.0).otherwise(score)).withColumn("reason", F.when(atoms <= 0, "no_valid_mcs_or_scaffold").otherwise("mcs_scaffold_supported"))
    return rows.withColumn("confidence_level", confidence_level(F.col("backbone_confidence"))).withColumn("passes", F.col("backbone_confidence") >= PASS)


def recommend(scored: DataFrame, top: int = 3, prune: bool = True, least: float = PASS) -> DataFrame:
    """The best candidates of each cluster; clusters without a passing one vanish."""
    kept = scored.where(F.col("backbone_confidence") >= least) if prune else scored
    order = Window.partitionBy(*KEYS).orderBy(F.desc("similarity"), "rank", "library_index")
    return (
        kept.withColumn("recommendation_rank_in_cluster", F.row_number().over(order).cast("long")).where(F.col("recommendation_rank_in_cluster") <= top)
        .withColumns({"recommendation_cluster": F.col("cluster"), "compound_level_pruning_used": F.lit(prune), "compound_level_confidence_threshold": F.lit(least)})
    )


def evidence_from(neighbors: DataFrame, provider: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Evidence by a provider that sees one cluster at a time; it is a toolkit's job and not part of this library."""
    return neighbors.groupBy(*KEYS).applyInPandas(provider, schema)


def no_evidence(neighbors: DataFrame) -> DataFrame:
    """One placeholder row per query; its null cluster joins to nothing."""
    keys = neighbors.select("method", "query_index").distinct()
    zero = {c: F.lit(0).cast("long") for c in ("n_molecules", "mcs_num_atoms", "mcs_num_bonds")}
    return keys.withColumns({"cluster": F.lit(None).cast("long"), "smarts": F.lit(""), "scaffold_smiles": F.lit(""), **zero, "mean_similarity": F.lit(0.0), "max_similarity": F.lit(0.0), "confidence": F.lit(0.0), "mcs_canceled": F.lit(False)})


def scaffolds(neighbors: DataFrame) -> DataFrame:
    """Adds candidate_scaffold and candidate_scaffold_atoms by Murcko scaffolds of distinct SMILES; needs RDKit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from rdkit import Chem
        from rdkit.Chem.Scaffolds import MurckoScaffold

        def one(s: str) -> tuple[str, int]:
            mol = Chem.MolFromSmiles(s) if s else None
            core = MurckoScaffold.GetScaffoldForMol(mol) if mol is not None else None
            return (Chem.MolToSmiles(core), core.GetNumAtoms()) if core is not None else ("", 0)

        for b in batches:
            found = [one(s) for s in b["smiles"]]
            yield pd.DataFrame({"smiles": b["smiles"], "candidate_scaffold": [f[0] for f in found], "candidate_scaffold_atoms": [f[1] for f in found]})

    try:
        import rdkit  # noqa: F401
    except ImportError as error:
        raise ImportError("scaffolds need RDKit; give candidate_scaffold and candidate_scaffold_atoms as columns instead") from error
    distinct = neighbors.select("smiles").distinct().mapInPandas(run, "smiles string, candidate_scaffold string, candidate_scaffold_atoms long")
    return neighbors.join(distinct, "smiles", "left")
