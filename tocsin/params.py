"""Analysis parameters."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    """Settings of one analysis; hours are integers starting at 1.

    ``hmax=None`` means the episode is followed to its own last hour.
    """

    tmin: int = 6
    hmax: int | None = 168
    smooth_length: int = 3
    epsilon: float = 1e-6
    alphas: tuple[float, ...] = (0.05, 0.10)
    delta: float = 0.05
    cuts: tuple[int, ...] = (12, 24, 48, 72)
    min_episodes: int = 50
    scale_floor: float = 0.10
    separation: int = 6
    warning_hours: int = 6
    short_lead: int = 3
    prevalence: float = 0.10
    score_digits: int | None = None

    def __post_init__(self) -> None:
        if self.hmax is not None and self.hmax < self.tmin:
            raise ValueError("hmax must be at least tmin")
        if self.smooth_length < 1:
            raise ValueError("smooth_length must be positive")
        if any(not 0 < a < 1 for a in (*self.alphas, self.delta)):
            raise ValueError("alpha and delta must lie in (0, 1)")

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)

    @property
    def boundaries(self) -> tuple[int, ...]:
        """Unmerged bin boundaries: tmin, the inner cuts, hmax."""
        if self.hmax is None:
            raise ValueError("bins need a finite hmax")
        inner = [c for c in self.cuts if self.tmin < c < self.hmax]
        return tuple(sorted({self.tmin, *inner, self.hmax}))
