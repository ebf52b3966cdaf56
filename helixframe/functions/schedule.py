"""Schedules over annealing steps: plain numbers on the driver."""

from __future__ import annotations

import bisect
from dataclasses import dataclass


def progress(beta: float, start: float, end: float) -> float:
    return 1.0 if end <= start else min(1.0, max(0.0, (beta - start) / (end - start)))


def annealed(first: float, last: float, at: float) -> float:
    return first + (last - first) * at


# The share of the run that the first value holds for, unless one is given.
FIRST_SHARE = {"late": 0.8, "early": 0.2}


@dataclass(frozen=True)
class Schedule:
    """Values with the places where they begin, on a run that is ``span`` long; ``ramp`` joins two values by a line."""

    values: tuple[int, ...]
    begins: tuple[float, ...]
    span: float = 1.0
    ramp: bool = False

    @staticmethod
    def parsed(text: str) -> Schedule:
        """``linear_a_b``, ``step_k0_k1_...``, ``late_a_b[_pct]`` or ``early_a_b[_pct]``."""
        kind, *rest = text.split("_")
        numbers = tuple(map(int, rest))
        if kind == "linear":
            return Schedule(numbers, (0.0, 1.0), ramp=True)
        if kind == "step":
            return Schedule(numbers, tuple(map(float, range(len(numbers)))), float(len(numbers)))
        if kind not in FIRST_SHARE:
            raise ValueError(f"unknown schedule {text!r}")
        turn = numbers[2] / 100 if len(numbers) > 2 else FIRST_SHARE[kind]
        return Schedule(numbers[:2], (0.0, turn))

    def at(self, share: float) -> int:
        if self.ramp:
            return round(self.values[0] * (1 - share) + self.values[1] * share)
        return self.values[bisect.bisect_right(self.begins, share * self.span) - 1]


def branches(schedule: str | list[int] | None, default: int, step: int, limit: int) -> int:
    """The branch factor of a step, 1 at least. A list gives it by step, its last entry from its end on."""
    if isinstance(schedule, str):
        return max(1, Schedule.parsed(schedule).at(step / max(limit - 1, 1)))
    if schedule is not None:
        return max(1, int([*schedule[: step + 1]][-1]))
    return default
