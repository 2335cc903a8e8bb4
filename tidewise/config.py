"""Column roles, presets, search spaces and execution limits."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

SPLITS = ("temporal", "random", "cold_start", "global_temporal")

# A preset's models, its training effort, and the spaces that tuning searches.
PRESETS: dict[str, list[str]] = {
    "fast_training": ["Popularity", "ItemCF"],
    "medium_quality": ["Popularity", "ItemCF", "BPRMF"],
    "best_quality": ["Popularity", "ItemCF", "BPRMF"],
    "multimodal_high_quality": ["Popularity", "ItemCF", "BPRMF"],
}
EFFORT: dict[str, dict[str, dict[str, Any]]] = {
    "fast_training": {"BPRMF": {"epochs": 2}, "VBPR": {"epochs": 1}},
    "medium_quality": {"BPRMF": {"epochs": 5}, "VBPR": {"epochs": 3}},
    "best_quality": {"BPRMF": {"epochs": 15, "factors": 64}, "VBPR": {"epochs": 8, "id_factors": 48}},
    "multimodal_high_quality": {"BPRMF": {"epochs": 10, "factors": 64}, "VBPR": {"epochs": 6, "id_factors": 48}},
}
SEARCH_SPACES: dict[str, dict[str, list[Any]]] = {
    "BPRMF": {"factors": [16, 32, 64], "learning_rate": [0.01, 0.03, 0.1]},
    "VBPR": {"id_factors": [16, 24, 48], "learning_rate": [0.01, 0.02, 0.05]},
}
GRAPH_SEARCH_SPACE: dict[str, list[Any]] = {"factors": [16, 32, 64], "layers": [1, 2, 3]}


@dataclass(frozen=True)
class Columns:
    """Names of the interaction table's roles."""

    user: str = "user_id"
    item: str = "item_id"
    timestamp: str | None = "timestamp"
    label: str | None = None

    def required(self) -> list[str]:
        return [c for c in (self.user, self.item, self.timestamp, self.label) if c]


@dataclass(frozen=True)
class Execution:
    """history_partitions: buckets of a saved history index. mode: "whole" trains every model on all rows; "sampled" gives
    Popularity exact counts of all rows and the other models a stable sample of users, sample_interactions rows and
    max_history_per_user of a user at most; "auto" is sampled beyond max_interactions rows. max_catalog_items: the most
    frequent items of all rows that are ranked in sampled mode."""

    history_partitions: int = 256
    mode: str = "whole"
    max_interactions: int = 2_000_000
    sample_interactions: int = 1_000_000
    max_history_per_user: int = 200
    max_catalog_items: int = 2_000_000

    def __post_init__(self):
        if self.mode not in ("whole", "sampled", "auto"):
            raise ValueError("mode is whole, sampled or auto")
        if min(self.history_partitions, self.max_interactions, self.sample_interactions, self.max_history_per_user, self.max_catalog_items) < 1:
            raise ValueError("limits must be positive")


def preset(name: str) -> list[str]:
    if name not in PRESETS:
        raise ValueError(f"no preset {name!r}; there are {', '.join(sorted(PRESETS))}")
    return list(PRESETS[name])


def resolve_models(models: str | list[str] | None, preset_name: str) -> list[str]:
    """The requested models without repeats, or the preset's."""
    wanted = preset(preset_name) if models is None or models == "auto" else models
    names = list(dict.fromkeys([wanted] if isinstance(wanted, str) else wanted))
    if not names:
        raise ValueError("no models were requested")
    return names


def model_settings(preset_name: str, own: dict[str, dict[str, Any]] | None) -> dict[str, dict[str, Any]]:
    """The preset's training effort, overridden by the user's settings."""
    preset(preset_name)
    own = own or {}
    return {name: {**EFFORT[preset_name].get(name, {}), **own.get(name, {})} for name in {*EFFORT[preset_name], *own}}
