"""User functions of workflow steps: a registry, the permanent failure, and example handlers. A handler takes its inputs by
step name and gives a JSON-able result."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol


class PermanentError(Exception):
    """A failure that retrying cannot mend."""


class EffectLedger(Protocol):
    def do(self, key: str, effect: Callable[[], Any]) -> Any: ...


@dataclass
class MemoryLedger:
    """At most one recorded result a key; a failed effect is not recorded."""

    results: dict[str, Any] = field(default_factory=dict)
    suppressed: list[str] = field(default_factory=list)

    def do(self, key: str, effect: Callable[[], Any]) -> Any:
        if key in self.results:
            self.suppressed.append(key)
        else:
            self.results[key] = effect()
        return self.results[key]


@dataclass
class TaskContext:
    run_id: str
    task: str
    attempt: int
    inputs: dict[str, Any]
    ledger: EffectLedger = field(default_factory=MemoryLedger)
    artifacts: list[tuple[str, str, int, str]] = field(default_factory=list)

    def input(self, step: str) -> Any:
        """The output of an upstream step; a step that is no input is an error, one that gave nothing is None."""
        if step not in self.inputs:
            raise KeyError(f"{step} is not an input of {self.task}; inputs: {', '.join(sorted(self.inputs)) or 'none'}")
        return self.inputs[step]

    def do(self, operation: str, effect: Callable[[], Any]) -> Any:
        return self.ledger.do(f"{self.run_id}:{self.task}:{operation}", effect)

    def emit(self, name: str, content_type: str, content: bytes) -> None:
        import hashlib

        self.emit_hashed(name, content_type, hashlib.sha256(content).hexdigest(), len(content))

    def emit_hashed(self, name: str, content_type: str, sha256: str, size: int) -> None:
        """An artifact that is kept elsewhere, by its digest."""
        import re

        if not re.fullmatch("[0-9a-f]{64}", sha256):
            raise ValueError(f"{sha256!r} is not the SHA-256 of an artifact")
        self.artifacts.append((name, sha256, size, content_type))


class Registry:
    """Handlers by name; a name can be taken once."""

    def __init__(self) -> None:
        self._handlers: dict[str, Callable[[TaskContext], Any]] = {}

    def handle(self, name: str, handler: Callable[[TaskContext], Any]) -> None:
        if name in self._handlers:
            raise ValueError(f"handler {name!r} is registered already")
        self._handlers[name] = handler

    def lookup(self, name: str) -> Callable[[TaskContext], Any] | None:
        return self._handlers.get(name)

    def names(self) -> list[str]:
        return sorted(self._handlers)


def invoke(handler: Callable[[TaskContext], Any], ctx: TaskContext) -> dict:
    """Outcome of one attempt: output (JSON text), or error and whether it is permanent. Any exception is an outcome."""
    try:
        out = handler(ctx)
        return {"output": None if out is None else json.dumps(out), "error": None, "permanent": False}
    except PermanentError as e:
        return {"output": None, "error": str(e), "permanent": True}
    except Exception as e:  # noqa: BLE001  a handler may raise anything
        return {"output": None, "error": f"{type(e).__name__}: {e}", "permanent": False}


def run_steps(run_id: str, steps: list[tuple], registry: Registry) -> dict[str, dict]:
    """Outcomes by step of a workflow without faults, in dependency order, one attempt each; steps behind a failed one do
    not run."""
    done: dict[str, dict] = {}
    waiting = list(steps)
    while ready := [s for s in waiting if all(d in done and done[d]["error"] is None for d in s[4])]:
        for s in ready:
            inputs = {d: None if done[d]["output"] is None else json.loads(done[d]["output"]) for d in s[4]}
            handler = registry.lookup(s[3])
            ctx = TaskContext(run_id, s[2], 1, inputs)
            done[s[2]] = invoke(handler, ctx) if handler else {"output": None, "error": f"handler {s[3]!r} is not registered", "permanent": True}
            waiting.remove(s)
    return done


def examples() -> Registry:
    """The handlers that the example workflows name."""
    r = Registry()
    only = lambda c: next(iter(c.inputs.values()), None) or {}
    r.handle("import_csv", lambda c: {"rows": 1000})
    r.handle("validate_rows", lambda c: {"valid": only(c)["rows"] - only(c)["rows"] % 7, "invalid": only(c)["rows"] % 7})
    r.handle("analyze", lambda c: {"mean": only(c)["valid"] / 2})
    r.handle("generate_report", lambda c: {"report": only(c)})
    r.handle("split_input", lambda c: {"shards": 3})
    r.handle("process_shard", lambda c: {"records": 100 + len(c.task)})
    r.handle("merge_shards", lambda c: {"records": sum(x["records"] for x in c.inputs.values())})
    r.handle("slow_step", lambda c: {"ok": True})
    r.handle("summarize", lambda c: {"inputs": sorted(c.inputs)})
    r.handle("charge_once", lambda c: c.do("charge", lambda: {"charged": True}))
    r.handle("effect_then_die", lambda c: c.do("charge", lambda: {"charged": True}))
    return r


def failing(base: Registry, rate: float) -> Registry:
    """base with a share of attempts failing, the same ones at every run: drawn from the attempt, run, task and handler."""
    from ..operators.simulate import draw

    if rate <= 0:
        return base
    out = Registry()
    for name in base.names():

        def wrapped(c: TaskContext, name: str = name) -> Any:
            if draw(c.attempt, c.run_id, "bench-fault", c.task, name) < rate:
                raise RuntimeError(f"injected benchmark failure at {rate * 100:.1f}% fault rate")
            return base.lookup(name)(c)

        out.handle(name, wrapped)
    return out


class ScenarioSource:
    """The scenario of each run, looked up once. A run that names a scenario that is not known, or is known under another
    hash, is an error: without its faults it would pass a test that never ran."""

    def __init__(self, scenarios: dict[str, dict], scenario_of: Callable[[Any], tuple[str, str]]) -> None:
        self._scenarios, self._scenario_of, self._seen = scenarios, scenario_of, {}

    def for_run(self, run_id: Any) -> dict | None:
        if run_id not in self._seen:
            name, digest = self._scenario_of(run_id)
            found = self._scenarios.get(name) if name else None
            if name and (found is None or digest and found.get("hash") != digest):
                raise LookupError(f"run {run_id} was started under scenario {name!r}, which is not known here")
            self._seen[run_id] = found
        return self._seen[run_id]
