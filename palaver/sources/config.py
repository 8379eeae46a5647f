"""Settings with defaults, from the environment or given."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    enabled_platforms: tuple[str, ...] = ("jitsi",)
    poll_seconds: int = 5
    join_deadline_seconds: int = 600
    left_alone_seconds: int = 300
    most_bots: int = 5
    turn_gap_ms: int = 750
    least_turn_ms: int = 400
    pad_ms: int = 250
    chunk_seconds: int = 600
    calls_at_once: int = 3
    provider: str = "native"

    @property
    def turn_gap_s(self) -> float:
        return self.turn_gap_ms / 1000

    @property
    def least_turn_s(self) -> float:
        return self.least_turn_ms / 1000

    @property
    def pad_s(self) -> float:
        return self.pad_ms / 1000

    @staticmethod
    def read(env: Mapping[str, str] | None = None, prefix: str = "PALAVER_") -> Settings:
        """Numbers must be whole and positive; lists are separated by commas."""
        env, given = os.environ if env is None else env, {}
        for f in fields(Settings):
            raw = env.get(prefix + f.name.upper())
            if raw is None:
                continue
            if isinstance(f.default, int):
                if not raw.isdigit() or int(raw) < 1:
                    raise ValueError(f"{prefix}{f.name.upper()} must be a positive whole number")
                given[f.name] = int(raw)
            else:
                given[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip()) if isinstance(f.default, tuple) else raw
        return Settings(**given)
