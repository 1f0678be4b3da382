"""Settings: the configuration file, checks, and where the cache lies."""

from __future__ import annotations

import math
import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

#: The signals in their order, those that gate, and file names of a configuration.
SIGNALS = ("nesting", "lines", "bumps", "bool_ops", "stubs", "panics")
GATING = ("nesting", "bumps", "bool_ops", "stubs")
FORMATS = ("human", "json", "markdown", "pr-comment", "github", "sarif", "shields")
PAIR_FORMATS = ("human", "json", "markdown", "pr-comment")


@dataclass
class Settings:
    threshold: float = 30.0
    min: float | None = None
    top: int | None = None
    sort: str = "crap"
    missing: str = "pessimistic"
    format: str = "human"
    epsilon: float = 0.01
    try_weight: float = 1.0
    exclude: list[str] = field(default_factory=list)
    default_excludes: list[str] | None = None
    allow: list[str] = field(default_factory=list)
    gate: list[str] = field(default_factory=lambda: list(GATING))
    limits: dict[str, int] = field(default_factory=dict)
    duplicate_threshold: float = 0.82
    duplicate_min_nodes: int = 20
    triage_floor: float = 0.25

    def __post_init__(self):
        self.gate = [signal(x) for x in self.gate]
        self.limits = {signal(k): v for k, v in self.limits.items()}
        for name, low, high in (("threshold", 0, math.inf), ("epsilon", 0, math.inf), ("try_weight", 0, math.inf), ("duplicate_threshold", 0, 1), ("triage_floor", 0, 1)):
            value = getattr(self, name)
            if not isinstance(value, int | float) or isinstance(value, bool) or not low <= value <= high or math.isinf(value):  # also refuses NaN
                raise ValueError(f"{name} must be a number from {low} to {high}, not {value!r}")
        for name, allowed in (("sort", ("crap", "file")), ("missing", ("pessimistic", "optimistic", "skip")), ("format", FORMATS)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if any(not isinstance(v, int) or not 0 <= v < 1 << 32 for v in self.limits.values()):
            raise ValueError("limits must be whole numbers of 32 bits")


def signal(name: str) -> str:
    """A signal's name; hyphens are underscores."""
    if (out := name.replace("-", "_")) not in SIGNALS:
        raise ValueError(f"no such signal: {name}")
    return out


def from_text(text: str, **flags: object) -> Settings:
    """Settings of a TOML text, overridden by the flags that are not None. An unknown key is an error."""
    found = {k.replace("-", "_"): v for k, v in tomllib.loads(text).items()}
    if unknown := sorted(set(found) - {f.name for f in fields(Settings)}):
        raise ValueError(f"unknown setting: {', '.join(unknown)}")
    return Settings(**found | {k: v for k, v in flags.items() if v is not None})


def find(start: str, names: tuple[str, ...] = (".riskframe.toml", "riskframe.toml")) -> str | None:
    """The first configuration file from a folder upwards."""
    for folder in (Path(start).resolve(), *Path(start).resolve().parents):
        for name in names:
            if (folder / name).is_file():
                return str(folder / name)
    return None


def carries_pairs(format_: str) -> bool:
    """Whether a format has a place for duplicates; others skip that work, with a warning."""
    return format_ in PAIR_FORMATS


def cache_folder(target: str | None, workspace: str | None, config: str | None, env: dict | None = None) -> str | None:
    """Where the cache lies: the build's target folder, else the one that the environment names, else below the workspace, else beside the configuration."""
    env = os.environ if env is None else env
    if target:
        return os.path.join(target, "riskframe")
    if named := env.get("CARGO_TARGET_DIR"):
        return os.path.join(named, "riskframe")
    if workspace:
        return os.path.join(workspace, "target", "riskframe")
    return os.path.join(os.path.dirname(config), ".riskframe-cache") if config else None


def exit_code(errors: bool, gated: int, fail: bool) -> int:
    """2 after an error, 1 where the gate holds and something is gated, else 0."""
    return 2 if errors else 1 if fail and gated else 0
