"""Label-confusion analytics on Spark DataFrames."""

from importlib import import_module

#: Public names, by the module that has them; modules load when a name is asked for.
_PUBLIC = {
    "operators.counts": ("build_matrices", "builder_statistics", "count_pairs", "label_accuracy", "label_table", "matrix_metrics", "prune_unused", "top_confusions"),
    "operators.distance": ("all_distances", "average_linkage", "baselines", "distances", "nearest", "rank_by_distance", "sanity", "square"),
    "operators.interpret": ("interpretable_features",),
    "operators.matrix": ("bistochastic_cells", "eigen_table", "laplacian", "row_normalize", "spectral_features", "symmetrize"),
    "operators.profile": ("compare_profiles", "extract_profiles", "normalized_spectra", "profile_summary"),
    "operators.resample": ("bootstrap_replicates", "bootstrap_summary", "permutation_replicates", "permutation_summary", "stability", "synthetic_cells"),
    "operators.stats": ("correct_pvalues", "correction_summary", "kendall", "spearman"),
    "operators.texts": ("char_counts", "coverage", "label_pairs", "match_texts", "segment_texts", "text_statistics"),
    "operators.validation": ("compare_with_truth", "family_separation", "historical_validation", "method_comparison", "synthetic_validation", "validate_inputs", "validate_matrices"),
    "session": ("get_session",),
    "sources.config": ("PipelineSettings", "get_charset", "register_language", "settings_from_yaml"),
    "sources.engines": ("Engine", "get_engine", "recognize_images", "register_engine"),
    "sources.files": ("export_matrices", "image_plan", "load_texts", "read_images", "read_labels", "read_matrices", "read_texts", "render_images", "write_images", "write_labels", "write_matrices"),
}
_HOME = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)


def __dir__() -> list[str]:
    return sorted({*globals(), *__all__})
