"""A phased workflow with time and memory per phase."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

SCHEMA_VERSION = 2


@dataclass
class Metrics:
    phase: str
    elapsed_seconds: float
    user_seconds: float
    system_seconds: float
    max_rss_kb: int
    exit_code: int = 0
    samples: int = 1


@dataclass
class Runner:
    """Run named phases in order; a phase that raises is recorded with exit code 1 and ends the run."""

    phases: list[tuple[str, Callable[[], object]]] = field(default_factory=list)

    def phase(self, name: str, action: Callable[[], object]) -> Runner:
        self.phases.append((name, action))
        return self

    def run(self) -> list[dict]:
        out = []
        for name, action in self.phases:
            before, began, code = resource.getrusage(resource.RUSAGE_SELF), time.perf_counter(), 0
            try:
                action()
            except Exception:  # noqa: BLE001 - recorded as the phase's result
                code = 1
            after = resource.getrusage(resource.RUSAGE_SELF)
            out.append(asdict(Metrics(name, time.perf_counter() - began, after.ru_utime - before.ru_utime, after.ru_stime - before.ru_stime, after.ru_maxrss, code)))
            if code:
                break
        return out
