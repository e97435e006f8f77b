"""Named feature functions, packs and signal policies, applied by name to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .operators import features_anchored, features_core, features_ml, features_profile, features_regime, features_structure, features_vpa, signals
from .operators.quality import BAR_REQUIRED

Transform = Callable[..., DataFrame]


@dataclass
class Registry:
    """Transforms take a DataFrame and keyword parameters; a pack is a list of (transform, parameters)."""

    functions: dict[str, Transform] = field(default_factory=dict)
    packs: dict[str, list[tuple[str, dict]]] = field(default_factory=dict)
    required: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def register(self, name: str, fn: Transform, required: Iterable[str] = BAR_REQUIRED) -> None:
        if name in self.functions:
            raise ValueError(f"already registered: {name}")
        self.functions[name] = fn
        self.required[name] = tuple(required)

    def register_pack(self, name: str, steps: list[tuple[str, dict]]) -> None:
        unknown = [s for s, _ in steps if s not in self.functions]
        if unknown:
            raise ValueError(f"unknown functions in pack {name}: {unknown}")
        self.packs[name] = steps

    def names(self) -> list[str]:
        return sorted([*self.functions, *self.packs])

    def validate(self, config: list[dict]) -> list[str]:
        """Problems of a configuration list of {"type": name, "params": {...}}."""
        problems = []
        for i, entry in enumerate(config):
            if "type" not in entry:
                problems.append(f"entry {i} has no type")
            elif entry["type"] not in self.functions and entry["type"] not in self.packs:
                problems.append(f"entry {i}: unknown type {entry['type']}")
            elif not isinstance(entry.get("params", {}), dict):
                problems.append(f"entry {i}: params must be a mapping")
        return problems

    def apply(self, df: DataFrame, name: str, **params: object) -> DataFrame:
        if name in self.packs:
            for step, defaults in self.packs[name]:
                df = self.apply(df, step, **{**defaults, **params})
            return df
        if name not in self.functions:
            raise ValueError(f"unknown feature function: {name}")
        missing = [c for c in self.required[name] if c not in df.columns]
        if missing:
            raise ValueError(f"{name} needs columns {missing}")
        return df.transform(self.functions[name], **params)

    def apply_config(self, df: DataFrame, config: list[dict]) -> DataFrame:
        problems = self.validate(config)
        if problems:
            raise ValueError("; ".join(problems))
        for entry in config:
            df = self.apply(df, entry["type"], **entry.get("params", {}))
        return df


def default_registry() -> Registry:
    r = Registry()
    r.register("core_basics", features_core.core_pack)
    r.register("regime_basics", lambda df, **p: features_regime.regime_pack(df, "basics", **p))
    r.register("regime_fast", lambda df, **p: features_regime.regime_pack(df, "fast", **p))
    r.register("regime_slow", lambda df, **p: features_regime.regime_pack(df, "slow", **p))
    r.register("vpa", features_vpa.vpa_pack)
    r.register("avwap", features_anchored.avwap_pack)
    r.register("volume_profile", features_profile.profile_pack)
    r.register("structure_flow", features_structure.structure_and_flow_pack)
    r.register("ml_families", features_ml.ml_pack)
    return r


# Signal policies by name: each maps bars with features to (symbol, ts, signal, bars_held, decision).
POLICIES: dict[str, Transform] = {
    "vwap_revert": signals.vwap_revert, "vwap_momentum": signals.vwap_momentum, "ml_vpa": signals.model_vpa_signals,
}


def policy(name: str) -> Transform:
    if name not in POLICIES:
        raise ValueError(f"unknown policy {name}; known: {sorted(POLICIES)}")
    return POLICIES[name]
