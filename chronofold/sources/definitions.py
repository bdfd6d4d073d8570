"""Workflow and scenario files: strict reading into step, fault and assertion rows."""

from __future__ import annotations

import hashlib
import json

from ..functions.time import parse_ms

try:
    import yaml
except ImportError:  # YAML is optional; JSON is a subset of it
    yaml = None

_STEP = {"name", "handler", "depends_on", "retry", "timeout"}
_RETRY = {"max_attempts", "initial_delay", "multiplier", "max_delay", "jitter"}
_ASSERT = {"run_status", "lost_tasks", "duplicate_effects", "max_recovery_time_ms", "max_retries_per_task", "min_retries_per_task", "faults_injected"}


def _load(text: str) -> dict:
    data = yaml.safe_load(text) if yaml else json.loads(text)
    if not isinstance(data, dict):
        raise ValueError("the document is not a mapping")
    return data


def _only(data: dict, known: set[str], where: str) -> None:
    if extra := sorted(set(data) - known):
        raise ValueError(f"{where}: unknown field {extra[0]!r}")


def _ms(value, where: str) -> int | None:
    if value is None:
        return None
    if not isinstance(value, str):
        raise ValueError(f"{where}: {value!r} needs a unit, such as 30s")
    return parse_ms(value)


def parse_workflow(text: str) -> dict:
    """name, version, steps (rows of operators.dag.STEPS), canonical (JSON of what the definition means) and hash."""
    data = _load(text)
    _only(data, {"name", "version", "steps"}, "workflow")
    rows = []
    for i, s in enumerate(data.get("steps") or [], 1):
        _only(s, _STEP, f"step {i}")
        r = s.get("retry") or {}
        _only(r, _RETRY, f"step {i}: retry")
        rows.append((data.get("name"), i, s.get("name"), s.get("handler"), list(s.get("depends_on") or []), r.get("max_attempts"), _ms(r.get("initial_delay"), "initial_delay"),
                     float(r["multiplier"]) if "multiplier" in r else None, _ms(r.get("max_delay"), "max_delay"), float(r["jitter"]) if "jitter" in r else None, _ms(s.get("timeout"), "timeout")))
    canonical = json.dumps([data.get("name"), data.get("version"), rows], sort_keys=True)
    return {"name": data.get("name"), "version": data.get("version"), "steps": rows, "canonical": canonical, "hash": hashlib.sha256(canonical.encode()).hexdigest()}


def parse_scenario(text: str) -> dict:
    """name, seed, workflow, faults (dicts with type, at, probability, task, attempt, params) and asserts (a dict; what is
    not in it is not asserted)."""
    data = _load(text)
    _only(data, {"name", "seed", "workflow", "faults", "assert"}, "scenario")
    faults = []
    for i, f in enumerate(data.get("faults") or [], 1):
        _only(f, {"type", "target", "at", "probability", "params"}, f"fault {i}")
        t = f.get("target") or {}
        _only(t, {"task", "attempt", "workflow"}, f"fault {i}: target")
        faults.append({"type": f.get("type"), "at": f.get("at"), "probability": float(f.get("probability") or 0), "task": t.get("task"), "attempt": int(t.get("attempt") or 0), "params": f.get("params") or {}})
    asserts = data.get("assert") or {}
    _only(asserts, _ASSERT, "assert")
    return {"name": data.get("name"), "seed": data.get("seed"), "workflow": data.get("workflow"), "faults": faults, "asserts": asserts}
