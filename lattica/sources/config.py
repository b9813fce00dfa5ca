"""Configuration of a study, from JSON."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, fields

from lattica.operators.models import REGISTRY


@dataclass(frozen=True)
class Config:
    """A study's settings; keys of the JSON are these names in capitals. Null and absent ones keep the defaults."""

    filenames_to_load: tuple[str, ...] = ()
    filenames_to_skip: tuple[str, ...] = ()
    dates_filename: str | None = None
    mkt_returns_filename: str | None = None
    rf_returns_filename: str | None = None
    output_format: str | None = None
    data_freq: str = "d"
    target_variable: str = "dummy_forward_max_drawdown"
    target_variable_rolling_window: int = 21
    quantile_for_dummy: float = 0.1
    returns_type: str = "raw"
    mkt_benchmark_column: str | None = None
    limit_ffill_betas: int | None = None
    limit_ffill_rf: int | None = None
    forecasting_horizon: int = 0
    lookback_corr: int = 252
    inner_train_size: int = 252
    inner_val_size: int = 42
    inner_step_size: int | None = None
    scoring_metric: str = "roc_auc"
    load_or_compute_cv: str = "compute"
    save_cv: bool = False
    threshold_grid: tuple[float, ...] = (0.75,)
    model_grid: tuple[dict, ...] = ()

    @classmethod
    def from_json(cls, text: str) -> Config:
        """From JSON text, whose keys may lie in sections."""
        flat: dict = {}

        def take(part: dict) -> None:
            for key, value in part.items():
                if isinstance(value, dict) and key.lower() not in known:
                    take(value)
                elif key.lower() in known and value is not None:
                    flat[key.lower()] = tuple(value) if isinstance(value, list) else value

        known = {f.name for f in fields(cls)}
        take(json.loads(text))
        config = cls(**flat)
        for model in config.model_grid:
            if model["model"] not in REGISTRY:
                raise KeyError(model["model"])
        return config

    def models(self) -> dict[str, tuple[str, dict, list[dict]]]:
        """The model grid as walkforward.Grid takes it."""
        return {m.get("label", m["model"]): (m["model"], m.get("model_kwargs", {}), m.get("param_grid") or [{}]) for m in self.model_grid}

    def cache_key(self, **more: object) -> str:
        """16 hex digits over all settings and what else decides a result (inputs, scheme)."""
        settings = {f.name: getattr(self, f.name) for f in fields(self)} | more
        return key_of(settings)


def key_of(settings: dict) -> str:
    """16 hex digits of the SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def registry(paths: list[str], skip: tuple[str, ...] = ()) -> dict[str, str]:
    """Attribute name (a file's stem) -> path. A path that isn't text, or a stem twice, is a ValueError."""
    found: dict[str, str] = {}
    for path in paths:
        if not isinstance(path, str):
            raise ValueError(f"a file name must be text, not {path!r}")
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        if stem in found:
            raise ValueError(f"two files are named {stem}")
        if stem not in skip:
            found[stem] = path
    return found
