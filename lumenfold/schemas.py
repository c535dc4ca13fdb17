"""Declared schemas of the engine's tables."""

from __future__ import annotations

PEAKS = "array<struct<mz:double,intensity:double>>"

LIBRARY = (
    "library_index long, COLLISION_ENERGY string, FORMULA string, FRAGMENTATION_MODE string, IDENTIFIER string, INSTRUMENT string, "
    "INSTRUMENT_TYPE string, ION_MODE string, adduct string, inchikey string, mona_id string, name string, smiles string, source string, "
    f"charge long, mona_idx long, num_peaks long, precursor_mz double, peaks {PEAKS}, embedding array<float>"
)
CHIMERA = (
    "query_index long, chimera_id string, chimera_type string, component_count long, dia_window_id long, dia_window_lower double, dia_window_upper double, "
    f"precursor_mz double, charge long, num_peaks long, peaks {PEAKS}, precursor_mz_list array<double>, mixing_weights array<double>, source_index array<long>, "
    "smiles string, inchikey string, name string, adduct string"
)
TOPK = "query_index long, rank long, library_index long, similarity double"
NEIGHBORS = (
    "method string, query_index long, library_index long, rank long, similarity double, cluster long, estimated_n_precursor_groups long, "
    "library_precursor_mz double, adaptive_k long, original_knn_k long, selected_segments long"
)
EVIDENCE = (
    "method string, query_index long, cluster long, smarts string, scaffold_smiles string, n_molecules long, mean_similarity double, "
    "max_similarity double, confidence double, mcs_num_atoms long, mcs_num_bonds long, mcs_canceled boolean"
)
SPECTRA = f"scan_index long, scan_id string, ms_level int, precursor_mz double, ionmode string, peaks {PEAKS}, file string"
