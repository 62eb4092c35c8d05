"""Exponential waiting times with a repeatable random part."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Backoff:
    """``base * multiplier ** (trip - 1)``, capped; at least half of it is always served.

    The random part depends on the key and the instant, not on a generator's
    state, so a replay waits exactly as long as the first run did.
    """

    base_seconds: float
    multiplier: float = 2.0
    cap_seconds: float = 3600.0
    extra_seconds: float = 0.0
    jitter: bool = True
    seed: int = 42

    def ceiling(self, trip: int) -> float:
        steps = min(max(trip - 1, 0), self.trips_to_cap)
        return min(self.base_seconds * self.multiplier**steps, self.cap_seconds)

    @property
    def trips_to_cap(self) -> int:
        """Trips after which the ceiling no longer grows."""
        if self.multiplier <= 1 or self.base_seconds >= self.cap_seconds:
            return 1
        return int(math.ceil(math.log(self.cap_seconds / self.base_seconds, self.multiplier))) + 1

    def seconds(self, key: str, at: float, trip: int) -> float:
        ceiling = self.ceiling(trip)
        if not self.jitter:
            return ceiling
        digest = hashlib.sha256(f"{self.seed}|{key}|{at!r}".encode()).digest()
        first = int.from_bytes(digest[:8], "big") / 2**64
        second = int.from_bytes(digest[8:16], "big") / 2**64
        return ceiling / 2 + first * ceiling / 2 + second * self.extra_seconds
