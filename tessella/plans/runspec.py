"""Configuration of a search run, from JSON or (where a reader is installed) YAML."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields
from pathlib import Path

from tessella.plans.themes import PAIRS

# Modes, guidance scopes, evaluator's factor models, suites in the order they run.
MODES, SCOPES, MODELS = ("default", "guided", "repair", "explore", "exploit"), ("none", "task", "loop", "task_and_loop"), (1, 3, 4, 5, 6, 7)
SUITES = ("multiple_testing", "double_bootstrap", "horse_race", "multi_model_alpha", "subsample", "spanning")


@dataclass(frozen=True)
class RunSpec:
    name: str
    pair: str
    mode: str = "default"
    seed_prompt: str | None = None
    guidance_scope: str = "none"
    n_generations: int = 10
    n_proposals: int = 6
    sample_filters: tuple[str, ...] = ("exclude_financials", "exclude_microcap")
    success_threshold: float = 1.96
    alpha_factor_model: int = 5
    max_tokens_in: int | None = None
    max_tokens_out: int | None = None
    max_wall_seconds: float | None = None
    suites: tuple[str, ...] = field(default=SUITES)

    def __post_init__(self):
        if not re.fullmatch(r"(?!\.)(?!.*\.\.)[^/\\\s][^/\\]*", self.name):
            raise ValueError(f"run name {self.name!r} isn't a folder's name")
        for name, known in (("pair", PAIRS), ("mode", MODES), ("guidance_scope", SCOPES), ("alpha_factor_model", MODELS)):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {sorted(known)}")
        if self.seed_prompt is not None and self.guidance_scope == "none":
            raise ValueError("a seed prompt needs a guidance scope")
        if set(self.suites) - set(SUITES):
            raise ValueError(f"unknown suites {sorted(set(self.suites) - set(SUITES))}")

    @property
    def ordered_suites(self) -> list[str]:
        return [s for s in SUITES if s in self.suites]


def from_mapping(given: dict) -> RunSpec:
    unknown = set(given) - {f.name for f in fields(RunSpec)}
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return RunSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def load(path: str | Path) -> RunSpec:
    text = Path(path).read_text()
    if str(path).endswith((".yaml", ".yml")):
        import yaml

        return from_mapping(yaml.safe_load(text))
    return from_mapping(json.loads(text))


def for_all_pairs(spec: RunSpec) -> list[RunSpec]:
    return [RunSpec(**{**vars(spec), "pair": p}) for p in PAIRS]
