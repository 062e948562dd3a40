"""A small runner for dataflow graphs: nodes are functions of their inputs' results, checks are attached to nodes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from graphlib import TopologicalSorter
from typing import Any


@dataclass
class Graph:
    nodes: dict[str, tuple[Callable[..., Any], tuple[str, ...]]] = field(default_factory=dict)
    checks: dict[str, list[tuple[str, Callable[[Any], bool]]]] = field(default_factory=dict)

    def node(self, name: str, needs: Sequence[str], run: Callable[..., Any]) -> None:
        if name in self.nodes:
            raise ValueError(f"node {name} exists")
        self.nodes[name] = (run, tuple(needs))

    def check(self, name: str, label: str, holds: Callable[[Any], bool]) -> None:
        self.checks.setdefault(name, []).append((label, holds))

    def run(self, inputs: Mapping[str, Any] | None = None) -> tuple[dict[str, Any], list[tuple[str, str, str]]]:
        """Results by node, and (node, check, passed | failed | skipped). A node below a failed check or node is skipped."""
        done, report, bad = dict(inputs or {}), [], set()
        for name in TopologicalSorter({n: needs for n, (_, needs) in self.nodes.items()}).static_order():
            if name in done:
                continue
            if name not in self.nodes:
                raise KeyError(f"no node or input {name}")
            run, needs = self.nodes[name]
            if bad & set(needs):
                bad.add(name)
                report += [(name, label, "skipped") for label, _ in self.checks.get(name, [])]
                continue
            done[name] = run(*(done[n] for n in needs))
            for label, holds in self.checks.get(name, []):
                ok = bool(holds(done[name]))
                report.append((name, label, "passed" if ok else "failed"))
                if not ok:
                    bad.add(name)
        return done, report


def fallback(steps: Sequence[tuple[str, Callable[[], Any]]]) -> tuple[Any, list[tuple[str, str]]]:
    """The first step's result that does not raise, and the log of attempts; the last error is raised if all fail."""
    log: list[tuple[str, str]] = []
    error: Exception | None = None
    for name, step in steps:
        try:
            out = step()
        except Exception as e:  # noqa: BLE001
            error = e
            log.append((name, f"error: {e}"))
            continue
        return out, [*log, (name, "ok")]
    raise error or ValueError("no steps")
