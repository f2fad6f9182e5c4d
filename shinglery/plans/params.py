"""Parameters of the fingerprinting plans."""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from pathlib import Path

from shinglery.plans.families import CANONICAL_A, CANONICAL_B

M32 = 0xFFFFFFFF


def seeded_family(functions: int, family_seed: int = 0) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Coefficients a and b; multipliers are odd, so that each function is a bijection."""
    rng = random.Random(family_seed)
    a = tuple(rng.randrange(1, M32 + 1) | 1 for _ in range(functions))
    return a, tuple(rng.randrange(1, M32 + 1) for _ in range(functions))


@dataclass(frozen=True)
class MinHashParams:
    """Shingle width `k` in bytes, hash seed, function family and number of bucket lanes.

    Rows per lane follow from the family size and the lane count. The seed serves the shingle hash
    and the bucket hash alike. The family is a seeded one of 128 functions, unless another is given.
    """

    k: int = 4
    seed: int = 1
    lanes: int = 64
    a: tuple[int, ...] = field(default_factory=lambda: seeded_family(128)[0])
    b: tuple[int, ...] = field(default_factory=lambda: seeded_family(128)[1])

    def __post_init__(self):
        if self.k < 1:
            raise ValueError("k must be positive")
        if not 0 <= self.seed <= M32:
            raise ValueError("seed must be an unsigned 32-bit integer")
        if len(self.a) != len(self.b) or not self.a:
            raise ValueError("the family needs as many a as b")
        if any(not 0 <= x <= M32 for x in (*self.a, *self.b)):
            raise ValueError("coefficients must be unsigned 32-bit integers")
        if self.lanes < 1 or len(self.a) % self.lanes:
            raise ValueError("the number of functions must be a multiple of the lanes")

    @property
    def functions(self) -> int:
        return len(self.a)

    @property
    def rows(self) -> int:
        return len(self.a) // self.lanes

    @classmethod
    def seeded(cls, functions: int = 128, family_seed: int = 0, **rest) -> MinHashParams:
        """A reproducible family of any size."""
        a, b = seeded_family(functions, family_seed)
        return cls(a=a, b=b, **rest)

    @classmethod
    def canonical(cls, **rest) -> MinHashParams:
        """The fixed family, with which known signatures and buckets agree."""
        return cls(a=CANONICAL_A, b=CANONICAL_B, **rest)

    @classmethod
    def from_file(cls, path: str, **rest) -> MinHashParams:
        """Reads one `a b` pair per line (blank or comma separated)."""
        pairs = [x.replace(",", " ").split() for x in Path(path).read_text().splitlines() if x.strip()]
        return cls(a=tuple(int(p[0]) for p in pairs), b=tuple(int(p[1]) for p in pairs), **rest)
