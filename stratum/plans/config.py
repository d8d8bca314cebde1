"""Validated limits of a run."""

from __future__ import annotations

from dataclasses import dataclass

CONTEXT_LIMIT, OUTPUT_RESERVE, SAFETY_MARGIN = 64_000, 2_000, 1_000
SHARD_BYTES, CHUNKS_PER_WORKER = 64 * 1024, 128
#: Token budgets by role.
ROLE_BUDGETS = {"supervisor": 8_000, "fact_extractor": 12_000, "analyst": 16_000, "risk_reviewer": 14_000, "comparator": 16_000, "reducer": 16_000, "validator": 10_000, "finalizer": 20_000}
SPECIALISTS = ("fact_extractor", "analyst", "risk_reviewer", "comparator")


@dataclass(frozen=True)
class Limits:
    context_limit: int = CONTEXT_LIMIT
    max_workers: int = 8
    default_agents: int = 3
    shard_bytes: int = SHARD_BYTES
    fan_in: int = 4
    max_replans: int = 1

    def __post_init__(self) -> None:
        bounds = {"context_limit": (8_000, None), "max_workers": (1, 32), "default_agents": (1, 32), "shard_bytes": (16 * 1024, 4 * 1024 * 1024), "fan_in": (2, 8), "max_replans": (0, 3)}
        for name, (low, high) in bounds.items():
            value = getattr(self, name)
            if value < low or (high is not None and value > high):
                raise ValueError(f"{name} must be at least {low}" + (f" and at most {high}" if high else ""))
        object.__setattr__(self, "default_agents", min(self.default_agents, self.max_workers))
