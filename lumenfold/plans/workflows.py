"""The four workflows: retrieval with evaluation, library encoding, simulation, encoding of runs."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import decompose, encode, evaluate, filters, retrieve, score, simulate
from ..sources import cache, readers


@dataclass(frozen=True)
class RetrievalConfig:
    method: str = "binned"
    k: int = 100
    strategy: str = "auto"
    adaptive: bool = True
    query_limit: int | None = None
    max_components: int = 20
    top_per_cluster: int = 3
    least_confidence: float = score.PASS
    prune: bool = True


def retrieve_and_decompose(queries: DataFrame, library: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Neighbour rows with metadata."""
    topk = retrieve.topk_cosine(filters.first_queries(queries, config.query_limit), library, config.k, config.strategy)
    return decompose.with_metadata(decompose.decompose(topk, library, config.method, config.max_components, adaptive=config.adaptive), library)


def cached_topk(spark: SparkSession, query_path: str, library_path: str, root: str, config: RetrievalConfig = RetrievalConfig(), force: bool = False) -> DataFrame:
    """The Top-K of two folders of embedding files, kept under a fingerprint of both sides' files and of what shapes the result."""
    shape = {"k": config.k, "query_limit": config.query_limit}
    mark = cache.fingerprint(shape, queries=cache.snapshot(spark, query_path), library=cache.snapshot(spark, library_path))

    def make() -> DataFrame:
        queries = filters.first_queries(readers.read_embeddings(spark, query_path), config.query_limit)
        return retrieve.topk_cosine(queries, readers.read_embeddings(spark, library_path, "library_index"), config.k, config.strategy)

    return cache.cached(spark, cache.cache_path(root, f"topk{config.k}", config.method, mark), make, shape | {"queries": query_path, "library": library_path}, force)


def evaluate_methods(spark: SparkSession, predictions: dict[str, str], out: str) -> DataFrame:
    """Accuracy of each method's written predictions as one table and as CSV beside it."""
    evaluate.combined({name: spark.read.parquet(path) for name, path in predictions.items()}).coalesce(1).write.mode("overwrite").parquet(f"{out}/combined_component_count_eval")
    rows = spark.read.parquet(f"{out}/combined_component_count_eval")
    cache.write_csv(rows, f"{out}/combined_component_count_eval.csv")
    return rows


def recommend(neighbors: DataFrame, evidence: DataFrame | None, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """neighbors with candidate_scaffold and candidate_scaffold_atoms."""
    return score.recommend(score.backbone_confidence(neighbors, evidence), config.top_per_cluster, config.prune and evidence is not None, config.least_confidence)


def run_retrieval(spark: SparkSession, queries: DataFrame, library: DataFrame, out: str, truth: DataFrame | None = None, evidence: DataFrame | None = None, config: RetrievalConfig = RetrievalConfig()) -> dict[str, str]:
    """Writes neighbours, predictions, recommendations (if there is evidence), accuracy (if there is truth) and a manifest."""
    paths = {k: f"{out}/{k}" for k in ("neighbors", "predictions", "recommendations", "accuracy")}
    retrieve_and_decompose(queries, library, config).write.mode("overwrite").parquet(paths["neighbors"])
    neighbors = spark.read.parquet(paths["neighbors"])
    rows = evaluate.predictions(neighbors, truth)
    rows.write.mode("overwrite").parquet(paths["predictions"])
    if truth is not None:
        evaluate.accuracy(rows).write.mode("overwrite").parquet(paths["accuracy"])
    if evidence is not None:
        held = {"candidate_scaffold", "candidate_scaffold_atoms"} <= set(neighbors.columns)
        recommend(neighbors if held else score.scaffolds(neighbors), evidence, config).write.mode("overwrite").parquet(paths["recommendations"])
    made = {k: p for k, p in paths.items() if cache.exists(spark, p)}
    cache.manifest(spark, f"{out}/manifest.json", asdict(config), made)
    return made


def encode_library(spark: SparkSession, path: str, root: str, encoder: str = "binned", force: bool = False, key: str = "library_index", **settings) -> DataFrame:
    """A library's vectors, cached under a fingerprint of the settings and the files."""
    mark = cache.fingerprint(settings | {"encoder": encoder, "key": key}, files=cache.snapshot(spark, path))
    return cache.cached(spark, cache.cache_path(root, "library", encoder, mark), lambda: encode.encode(encoder, readers.read_library(spark, path), key, **settings), settings | {"encoder": encoder, "source": path}, force)


def simulate_mixtures(spark: SparkSession, path: str, out: str, n_two: int = 100_000, n_three: int = 100_000, seed: int = 42) -> DataFrame:
    library = filters.valid_spectra(readers.read_library(spark, path), need=("smiles", "inchikey"))
    simulate.simulate(library, n_two, n_three, seed).write.mode("overwrite").parquet(out)
    cache.save_json(spark, f"{out}_meta.json", {"source": path, "n_two": n_two, "n_three": n_three, "seed": seed})
    return spark.read.parquet(out)


def encode_run(spark: SparkSession, path: str, ms_level: int = 2, min_peaks: int = 1, losses: bool = False, **settings) -> DataFrame:
    """Sparse vectors of a run's spectra; raises if none is usable."""
    spectra = filters.run_spectra(readers.read_mzml(spark, path), ms_level, min_peaks)
    if spectra.isEmpty():
        raise ValueError("no usable spectrum")
    return encode.run_binned(spectra, losses=losses, **settings)


def save_run(spark: SparkSession, encoded: DataFrame, spectra: DataFrame, out: str, provenance: dict | None = None) -> DataFrame:
    """Writes a run's vectors with scan ids, precursors and ion modes, and a note of where they come from. Both sides: scan_index, of one file.

    Every vector has one row; spectra without a vector have none.
    """
    held = spectra.select("scan_index", "scan_id", "precursor_mz", "ionmode")
    encoded.join(held, "scan_index", "left").write.mode("overwrite").parquet(out)
    cache.save_json(spark, f"{out}_meta.json", provenance or {})
    return spark.read.parquet(out)
