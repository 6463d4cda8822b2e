"""Options with defaults, merged over by the caller's and checked."""

from __future__ import annotations

from copy import deepcopy

from ..errors import ConfigurationError

# Names and defaults of the options, and what some may be.
DEFAULTS = {
    "preprocessing": {"patch_sizes": [64], "patch_strides": [64]},
    "discovery": {"max_candidate_anomalies": 10, "max_concepts": 5, "novelty_strategy": "hybrid", "cluster_distance_threshold": 0.35, "weight_global_distance": 0.5, "weight_neighbor_distance": 0.5, "max_per_image": 3, "min_spatial_distance": 32.0},
    "tabular": {"id_column": None, "max_categorical_cardinality": 50},
    "timeseries": {"timestamp_column": None, "entity_column": None, "window_size": 3},
    "reference_scoring": {"metric": "euclidean", "neighbor_count": 1, "image_aggregation": "max_patch", "top_fraction": 0.1, "map_projection": "overlap_mean", "multi_scale_fusion": "max", "smoothing_sigma": 0.0},
    "calibration": {"method": "identity"},
}
CHOICES = {
    ("discovery", "novelty_strategy"): ("hybrid", "global_distance", "memory_neighbor_distance", "centroid_distance", "nearest_neighbor_distance", "robust_z_score", "distance_to_center"),
    ("reference_scoring", "metric"): ("euclidean", "cosine"),
    ("reference_scoring", "image_aggregation"): ("max_patch", "top_fraction_mean"),
    ("reference_scoring", "map_projection"): ("overlap_mean", "overlap_max"),
    ("reference_scoring", "multi_scale_fusion"): ("mean", "max"),
    ("calibration", "method"): ("identity", "empirical_percentile", "minmax"),
}


def merge(base: dict, over: dict, path: tuple[str, ...] = ()) -> dict:
    out = deepcopy(base)
    for k, v in over.items():
        if k not in base:
            raise ConfigurationError(f"unknown option {'.'.join((*path, k))}")
        if isinstance(base[k], dict):
            if not isinstance(v, dict):
                raise ConfigurationError(f"{'.'.join((*path, k))} must be a section")
            out[k] = merge(base[k], v, (*path, k))
        else:
            out[k] = v
    return out


def load(options: dict | None = None) -> dict:
    """The defaults with options merged in; unknown options and values raise ConfigurationError, a ValueError.

    patch_size and patch_stride are read as lists of one.
    """
    options = deepcopy(options or {})
    pre = options.get("preprocessing", {})
    for old, new in (("patch_size", "patch_sizes"), ("patch_stride", "patch_strides")):
        if old in pre:
            pre.setdefault(new, [pre[old]])
            del pre[old]
    out = merge(DEFAULTS, options)
    for (section, key), allowed in CHOICES.items():
        if out[section][key] not in allowed:
            raise ConfigurationError(f"{section}.{key} must be one of {', '.join(allowed)}")
    sizes, strides = out["preprocessing"]["patch_sizes"], out["preprocessing"]["patch_strides"]
    if len(sizes) != len(strides) or not sizes or min(*sizes, *strides) <= 0:
        raise ConfigurationError("patch sizes and strides must be positive and as many")
    if out["timeseries"]["window_size"] < 1 or not 0 < out["reference_scoring"]["top_fraction"] <= 1:
        raise ConfigurationError("window_size and top_fraction are out of range")
    scoring = out["reference_scoring"]
    if scoring["neighbor_count"] < 1 or not 0 <= scoring["smoothing_sigma"] < float("inf"):
        raise ConfigurationError("neighbor_count and smoothing_sigma are out of range")
    return out
