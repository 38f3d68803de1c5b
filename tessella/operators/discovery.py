"""The search loop's control plane: tasks, proposals, validation, archive, budgets, recording.

Proposals come from a proposer; one that replays recorded texts is here, and no client of any service.
All of this runs on the driver: a generation is a handful of expressions.
"""

from __future__ import annotations

import fcntl
import json
import math
import os
import re
import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from hashlib import sha1
from pathlib import Path
from typing import Protocol

from tessella.plans.expression import check, dedupe_key, identity_form
from tessella.plans.themes import PAIRS, exclusive_items

# Fixed values of a task's contract.
REQUIRED = ("name", "expression", "hypothesis", "expected_sign", "reasoning", "interaction_type")
SIGNS, INTERACTIONS, CRITICAL = ("positive", "negative"), ("composite", "conditional", "ratio", "novel"), 1.96


@dataclass
class Proposal:
    name: str
    expression: str
    hypothesis: str = ""
    expected_sign: str = "positive"
    reasoning: str = ""
    interaction_type: str = "composite"
    theme_a: str = ""
    theme_b: str = ""
    author: str = "proposer"


@dataclass
class Evaluated(Proposal):
    generation: int = 0
    fmb_tstat: float | None = None
    ls_alpha: float | None = None
    ls_talpha: float | None = None
    ls_sharpe: float | None = None
    coverage: float | None = None
    error: str | None = None

    @property
    def outcome(self) -> str:
        t = self.fmb_tstat
        if self.error is not None or t is None or not math.isfinite(t):
            return "realization_failure"
        if abs(t) <= CRITICAL:
            return "opposing_weak"
        return "supporting" if (t > 0) == (self.expected_sign == "positive") else "opposing_wrong_sign"


@dataclass(frozen=True)
class Task:
    """A pair of themes to search, with what its proposals must hold."""

    pair: str
    required: tuple[str, ...] = REQUIRED
    signs: tuple[str, ...] = SIGNS
    interactions: tuple[str, ...] = INTERACTIONS
    reject_exact: bool = True
    reject_normalised: bool = True
    filters: tuple[str, ...] = ("exclude_financials", "exclude_microcap")

    @property
    def themes(self) -> tuple[str, str]:
        return PAIRS[self.pair]

    @property
    def task_id(self) -> str:
        return f"cross_theme:{self.pair}"


@dataclass
class Diagnostic:
    severity: str
    code: str
    message: str
    proposal_name: str
    metadata: dict = field(default_factory=dict)


@dataclass
class Archive:
    evaluated: list[Evaluated] = field(default_factory=list)
    considered: list[Proposal] = field(default_factory=list)
    critic_notes: list[dict] = field(default_factory=list)
    diagnostics: list[Diagnostic] = field(default_factory=list)
    generation: int = 0

    def successful(self) -> list[Evaluated]:
        return [e for e in self.evaluated if e.outcome == "supporting"]


class Validator:
    """Checks in order; the first that fails is the proposal's diagnostic."""

    def __init__(self, expressions: bool = True, themes: bool = True):
        self.expressions, self.themes = expressions, themes

    def _fault(self, p: Proposal, task: Task, exact: set[str], keys: set[str], meta: dict) -> Diagnostic | None:
        def fault(code: str, message: str, severity: str = "error", **more) -> Diagnostic:
            return Diagnostic(severity, code, message, p.name, {**meta, **more})

        for name in task.required:
            value = getattr(p, name, None)
            if value is None or not str(value).strip():
                return fault("missing_required_field", f"required field is empty: {name}", field=name)
        if p.expected_sign not in task.signs:
            return fault("invalid_expected_sign", "expected_sign must be one of " + ", ".join(task.signs))
        if p.interaction_type not in task.interactions:
            return fault("invalid_interaction_type", "interaction_type must be one of " + ", ".join(task.interactions))
        told = check(p.expression)
        meta["variables"] = sorted(told.variables)
        if self.expressions and not told.ok:
            return fault("invalid_expression", told.message)
        if self.themes and told.ok:
            for theme in task.themes:
                if not told.variables & exclusive_items(theme, [t for t in task.themes if t != theme]):
                    return fault("missing_required_theme", f"no item exclusive to theme {theme}", missing_theme=theme)
        if task.reject_exact and p.expression in exact:
            return fault("duplicate_expression", "repeats an expression exactly", "warning")
        if task.reject_normalised and dedupe_key(p.expression) in keys:
            return fault("duplicate_expression", "repeats an expression but for case and blanks", "warning")
        return None

    def validate(self, proposals: Iterable[Proposal], task: Task, archive: Archive) -> tuple[list[Proposal], list[Diagnostic]]:
        past = [*archive.considered, *archive.evaluated]
        exact, keys = {p.expression for p in past}, {dedupe_key(p.expression) for p in past}
        accepted, told = [], []
        for p in proposals:
            meta = {"normalized_expression": dedupe_key(p.expression)}
            fault = self._fault(p, task, exact, keys, meta)
            told.append(fault or Diagnostic("info", "accepted", "accepted for evaluation", p.name, meta))
            if fault is None:
                accepted.append(p)
                exact.add(p.expression)
                keys.add(dedupe_key(p.expression))
        return accepted, told


@dataclass
class Budget:
    """Caps that count as reached when met; looked at between generations only."""

    max_in: int | None = None
    max_out: int | None = None
    max_seconds: float | None = None
    used_in: int = 0
    used_out: int = 0
    started: float = field(default_factory=time.time)

    def record(self, tokens_in: int, tokens_out: int) -> None:
        self.used_in += tokens_in
        self.used_out += tokens_out

    def reason(self) -> str:
        if self.max_in is not None and self.used_in >= self.max_in:
            return "input tokens"
        if self.max_out is not None and self.used_out >= self.max_out:
            return "output tokens"
        return "time" if self.max_seconds is not None and time.time() - self.started >= self.max_seconds else ""


@dataclass(frozen=True)
class FixedGenerations:
    n: int

    def should_stop(self, archive: Archive, generation: int) -> bool:
        return generation >= self.n


@dataclass
class Batch:
    proposals: list[Proposal]
    considered: list[Proposal] = field(default_factory=list)
    notes: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    moderator: dict | None = None
    tokens_in: int = 0
    tokens_out: int = 0


class Proposer(Protocol):
    def propose(self, task: Task, archive: Archive, generation: int, n: int) -> Batch: ...


class QueueProposer:
    """Replays recorded batches of texts, one a generation; past the last, nothing."""

    def __init__(self, texts: list[str]):
        self.texts = texts

    def propose(self, task: Task, archive: Archive, generation: int, n: int) -> Batch:
        text = self.texts[generation] if generation < len(self.texts) else ""
        found = parse_proposals(text, task)
        call = {"role": "proposer", "round": 1, "prompt": task.task_id, "cache": False, "input_tokens": 0, "cached_input_tokens": 0, "response": text, "thinking": None, "output_tokens": len(text.split())}
        return Batch(found[:n], found, calls=[call], tokens_in=0, tokens_out=len(text.split()))


_BLOCK, _FIELD = re.compile(r"(?im)^-{2,}\s*SIGNAL\b.*$"), re.compile(r"(?im)^\s*([A-Z_ ]+?)\s*:\s*(.*)$")


def parse_proposals(text: str, task: Task) -> list[Proposal]:
    """Proposals of blocks headed `--- SIGNAL`, of lines FIELD: value; blocks without name or expression are left out."""
    out = []
    for block in _BLOCK.split(text)[1:]:
        given = {k.strip().lower().replace(" ", "_"): v.strip() for k, v in _FIELD.findall(block)}
        if given.get("name") and given.get("expression"):
            known = {k: v for k, v in given.items() if k in REQUIRED}
            known["expected_sign"] = known.get("expected_sign", "").lower()
            known["interaction_type"] = known.get("interaction_type", "").lower()
            out.append(Proposal(**known, theme_a=task.themes[0], theme_b=task.themes[1]))
    return out


def parse_critiques(text: str, names: list[str], generation: int = 0) -> list[dict]:
    """Notes of blocks headed `--- CRITIQUE name ---` on known names; a block without a verdict is left out."""
    parts = re.split(r"(?im)^-{3,}\s*CRITIQUE\s+(.+?)\s*-{3,}\s*$", text)
    out = []
    for name, body in zip(parts[1::2], parts[2::2], strict=False):
        told = {k: re.search(rf"(?is){k}\s*:\s*({p})", body) for k, p in (("VERDICT", "accept|flag"), ("SCORE", r"\d+"), ("RATIONALE", r".+?(?=\n\s*\n|\Z)"))}
        if name.strip() in names and told["VERDICT"]:
            out.append({"generation": generation, "target_name": name.strip(), "verdict": told["VERDICT"].group(1).lower(), "score": int(told["SCORE"].group(1)) if told["SCORE"] else 3, "rationale": told["RATIONALE"].group(1).strip() if told["RATIONALE"] else ""})
    return out


def without_nonfinite(value):
    """NaN and infinities become None, through dicts and lists."""
    if isinstance(value, dict):
        return {str(k): without_nonfinite(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [without_nonfinite(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def strict_json(value, **options) -> str:
    return json.dumps(without_nonfinite(value), allow_nan=False, **options)


def signal_id(source: str, name: str, expression: str) -> str:
    """Twelve signs that name a signal by where it was found, its name and its expression."""
    return sha1(json.dumps([source, name, identity_form(expression)], separators=(",", ":")).encode()).hexdigest()[:12]


class Recorder:
    """Writes a run's folder: eight files for each generation, the archive, diagnostics and progress as JSON lines, a
    status. Appends of several threads or processes don't mix: the file is locked; a status is replaced as a whole."""

    #: What is kept of a recorded call, in the files of prompts and of answers.
    PROMPT, ANSWER = ("role", "round", "prompt", "cache", "input_tokens", "cached_input_tokens"), ("role", "round", "response", "thinking", "output_tokens")

    def __init__(self, folder: str | Path, pair: str = ""):
        self.folder, self.pair, self.started, self.lock = Path(folder), pair, time.monotonic(), threading.Lock()
        self.folder.mkdir(parents=True, exist_ok=True)

    def _write(self, name: str, value) -> None:
        path = self.folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(f".{path.name}.{os.getpid()}.{threading.get_ident()}")
        part.write_text(strict_json(value, indent=2))
        part.replace(path)

    def _append(self, name: str, rows: list[dict]) -> None:
        path = self.folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        with self.lock, path.open("a") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            f.writelines(strict_json(r, sort_keys=True) + "\n" for r in rows)

    def generation(self, n: int, batch: Batch, results: list[Evaluated], told: list[Diagnostic]) -> None:
        at = f"generations/gen_{n:03d}"
        self._write(f"{at}/metadata.json", {"pair": self.pair, "generation": n})
        self._write(f"{at}/parsed_proposals.json", [asdict(p) for p in batch.proposals])
        self._write(f"{at}/considered_proposals.json", [asdict(p) for p in batch.considered])
        self._write(f"{at}/evaluation_results.json", [asdict(r) for r in results])
        self._write(f"{at}/critic_notes.json", batch.notes)
        self._write(f"{at}/moderator_note.json", batch.moderator)
        for name, kept in (("rendered_prompts", self.PROMPT), ("raw_responses", self.ANSWER)):
            self._append(f"{at}/{name}.jsonl", [{k: c.get(k) for k in kept} for c in batch.calls])
        self._append("validation_diagnostics.jsonl", [{**asdict(d), "generation": n} for d in told])

    def archive(self, archive: Archive) -> None:
        self._write("archive.json", {"pair": self.pair, **asdict(archive)})

    def progress(self, event: str, stage: str, generation: int | None = None, **metadata) -> None:
        row = {"schema_version": "1", "elapsed_sec": round(time.monotonic() - self.started, 3), "pair": self.pair, "generation": generation, "stage": stage, "event": event, "metadata": metadata}
        self._append("progress.jsonl", [row])
        self._write("status.json", row)


def run_search(task: Task, proposer: Proposer, evaluate: Callable[[list[Proposal], int], list[Evaluated]], stop, budget: Budget | None = None, recorder: Recorder | None = None, n: int = 6, validator: Validator | None = None) -> Archive:
    """Propose, validate, evaluate and record by generation until stop or budget says so. All proposals seen, chosen
    or not, are kept as considered, each expression once a generation."""
    archive, budget, validator = Archive(), budget or Budget(), validator or Validator()
    generation = 0
    while not stop.should_stop(archive, generation) and not budget.reason():
        batch = proposer.propose(task, archive, generation, n)
        budget.record(batch.tokens_in, batch.tokens_out)
        once = {}
        for p in [*batch.proposals, *batch.considered]:
            once.setdefault(dedupe_key(p.expression), p)
        accepted, told = validator.validate(batch.proposals, task, archive)
        results = evaluate(accepted, generation)
        archive.evaluated += results
        archive.considered += once.values()
        archive.critic_notes += batch.notes
        archive.diagnostics += told
        archive.generation = generation
        if recorder:
            recorder.generation(generation, batch, results, told)
            recorder.archive(archive)
            recorder.progress("generation_completed", "generation", generation, n_accepted=len(accepted))
        generation += 1
    return archive


def lesson_book(evidence: dict[str, str], mechanisms: list[dict]) -> list[dict]:
    """Mechanisms with their evidence by outcome. evidence: id -> outcome. Every id is cited exactly once; a
    mechanism of fewer than two usable evaluations stays unresolved."""
    cited = [i for m in mechanisms for i in m["evidence_ids"]]
    unknown, missing = set(cited) - set(evidence), set(evidence) - set(cited)
    if unknown or missing or len(cited) != len(set(cited)):
        raise ValueError(f"evidence must be cited once each: unknown {sorted(unknown)}, missing {sorted(missing)}, repeated {sorted({i for i in cited if cited.count(i) > 1})}")
    out = []
    for m in mechanisms:
        by: dict[str, list[str]] = {}
        for i in m["evidence_ids"]:
            by.setdefault(evidence[i], []).append(i)
        usable = sum(len(v) for k, v in by.items() if k != "realization_failure")
        if usable < 2 and m.get("status", "unresolved") != "unresolved":
            raise ValueError(f"mechanism {m['mechanism_id']} has fewer than two usable evaluations")
        out.append({**m, "supporting": by.get("supporting", []), "opposing": by.get("opposing_weak", []) + by.get("opposing_wrong_sign", []), "failures": by.get("realization_failure", [])})
    return out
