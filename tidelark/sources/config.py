"""Configurations: JSON, or YAML where a reader for it is installed, with defaults for what is not said."""

from __future__ import annotations

import json
from pathlib import Path

try:
    import yaml
except ModuleNotFoundError:  # JSON is always read
    yaml = None

DEFAULT: dict = {
    "horizons": [1, 3, 5, 10, 20],
    "ci": "hac",
    "n_boot": 1000,
    "labeller": {"features": ["vol_pct", "term_slope_pct", "rr_stress_pct"], "states": "auto", "least_episodes": 5, "budget": 30.0},
    "tags": {},
    "transitions": {"prior_strength": 10.0, "horizon": 21, "policy": "decay", "halflife": 10.0},
    "gates": {"max_h": 10, "spread_se": 2.0, "least": 0.75},
}


def merged(base: dict, more: dict) -> dict:
    """base with what ``more`` says; tables are merged, all else is replaced."""
    out = dict(base)
    for k, v in more.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_config(path: str | None = None, defaults: dict | None = None) -> dict:
    """The defaults with what the file says. A file that is no table, or YAML without a reader, is refused."""
    base = DEFAULT if defaults is None else defaults
    if path is None:
        return dict(base)
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        if yaml is None:
            raise ValueError("YAML needs a reader that is not installed; give JSON")
        found = yaml.safe_load(text) or {}
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("a configuration is a table of names and values")
    return merged(base, found)
