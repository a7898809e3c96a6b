"""A few dependent steps on the driver, each a Spark job or more."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter


class Fatal(RuntimeError):
    """An error that trying again won't mend."""


@dataclass
class Step:
    name: str
    run: Callable[[dict], object]
    after: tuple[str, ...] = ()
    attempts: int = 3


@dataclass
class Outcome:
    status: dict[str, str] = field(default_factory=dict)
    results: dict[str, object] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    @property
    def summary(self) -> str:
        kinds = set(self.status.values())
        return "succeeded" if kinds <= {"succeeded"} else "partial_success" if "succeeded" in kinds else "failed"


def order(steps: list[Step]) -> list[Step]:
    """Steps after all that they name; an unknown name, a repeated one or a circle is an error."""
    by = {s.name: s for s in steps}
    if len(by) < len(steps) or any(a not in by for s in steps for a in s.after):
        raise ValueError("a step is named twice or unknown")
    try:
        return [by[n] for n in TopologicalSorter({s.name: s.after for s in steps}).static_order()]
    except CycleError as circle:
        raise ValueError(f"steps go in a circle: {circle.args[1]}") from None


def run(steps: list[Step], wait: Callable[[float], None] = time.sleep) -> Outcome:
    """Runs steps in order. One that fails is tried again after 5, 10, 20 ... 60 s at most; what comes after a failed one is skipped."""
    out = Outcome()
    for step in order(steps):
        if any(out.status[a] != "succeeded" for a in step.after):
            out.status[step.name] = "skipped"
            continue
        for attempt in range(1, step.attempts + 1):
            try:
                out.results[step.name] = step.run(out.results)
                out.status[step.name] = "succeeded"
                break
            except Exception as error:
                out.status[step.name], out.errors[step.name] = "failed", str(error)
                if isinstance(error, Fatal) or attempt == step.attempts:
                    break
                wait(min(5 * 2 ** (attempt - 1), 60))
    return out
