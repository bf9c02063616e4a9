"""Bispectra of neighbours mapped to rotations: SO4, SNAP and LBispectrum.

An edge of length r becomes a rotation of the three-sphere by an angle that grows with r. Its matrices of order j act on
polynomials: row b holds the coefficients of (a* X - b* Y)^(j-b) (b X + a Y)^b in normalised monomials. A centre's
matrices are the weighted sums over its edges and its own identity; three orders couple into one real invariant.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import factorial, pi, sqrt

import numpy as np

from .base import require
from .local import Edges, _Local

#: Neighbours nearer than this are left out.
NEAREST = 1e-8


def rotation_matrices(d: np.ndarray, angle: np.ndarray, top: int) -> list[np.ndarray]:
    """Per order j to top: (edges, j+1, j+1), rows and columns from the highest power of X."""
    u = d / np.sqrt((d * d).sum(1))[:, None]
    a = np.cos(angle) - 1j * np.sin(angle) * u[:, 2]
    b = np.sin(angle) * (u[:, 1] - 1j * u[:, 0])
    p = np.ones((len(d), 1, 1), complex)
    out = [p]
    for j in range(1, top + 1):
        grown = np.zeros((len(d), j + 1, j + 1), complex)
        grown[:, :j, :j] += a.conj()[:, None, None] * p
        grown[:, :j, 1:] -= b.conj()[:, None, None] * p
        grown[:, j, :j] += b[:, None] * p[:, -1]
        grown[:, j, 1:] += a[:, None] * p[:, -1]
        p = grown
        norm = np.sqrt([float(factorial(k) * factorial(j - k)) for k in range(j + 1)])
        out.append(p * norm / norm[:, None])
    return out


def coupling(j1: int, j2: int, j: int) -> np.ndarray:
    """Clebsch-Gordan coefficients (j1+1, j2+1, j+1) of doubled angular momenta, by Racah's sum."""
    out = np.zeros((j1 + 1, j2 + 1, j + 1))
    if (j1 + j2 + j) % 2 or not abs(j1 - j2) <= j <= j1 + j2:
        return out
    f = lambda n: float(factorial(n))
    s, t, v = (j1 + j2 - j) // 2, (j1 - j2 + j) // 2, (j2 - j1 + j) // 2
    triangle = f(s) * f(t) * f(v) / f((j1 + j2 + j) // 2 + 1)
    for p in range(j1 + 1):
        for q in range(j2 + 1):
            r = p + q - s
            if not 0 <= r <= j:
                continue
            total = 0.0
            for k in range(max(0, j1 - p - t, q - v), min(s, j1 - p, q) + 1):
                total += (-1) ** k / (f(k) * f(s - k) * f(j1 - p - k) * f(q - k) * f(t - j1 + p + k) * f(v - q + k))
            out[p, q, r] = total * sqrt(triangle * (j + 1) * f(p) * f(j1 - p) * f(q) * f(j2 - q) * f(r) * f(j - r))
    return out


@dataclass(frozen=True)
class _Bispectrum(_Local):
    lmax: int = 3
    rcut: float = 3.5
    normalize_U: bool = False
    typed = False
    #: An atom without neighbours still has its own identity.
    keeps_self = True
    rfac0 = 1.0
    rmin0 = 0.0

    def __post_init__(self) -> None:
        require(self.lmax >= 0 and self.rcut > 0, "lmax is not negative, rcut is positive", "lmax")

    @property
    def reach(self) -> float:
        return self.rcut

    @property
    def order(self) -> int:
        return 2 * self.lmax

    def components(self) -> list[tuple[int, int, int]]:
        """Doubled momenta (first, second <= first, third >= first) that can couple."""
        return [(a, b, c) for a in range(self.order + 1) for b in range(a + 1) for c in range(a, min(self.order, a + b) + 1) if (a + b + c) % 2 == 0]

    def labels(self) -> list[str]:
        return [f"j={a}/2,{b}/2,{c}/2" for a, b, c in self.components()]

    def cutoffs(self, zi: np.ndarray, zj: np.ndarray) -> np.ndarray:
        return np.full(len(zj), self.rcut)

    def weights(self, z: np.ndarray, centre: bool) -> np.ndarray:
        raise NotImplementedError

    def kernel(self) -> Callable[[Edges], np.ndarray]:
        top, rmin, parts = self.order, self.rmin0, self.components()
        tables = {p: coupling(*p) for p in parts}

        def invariants(e: Edges) -> np.ndarray:
            within = self.cutoffs(e.zi[e.centres()], e.z)
            near = (e.r > NEAREST) & (e.r <= within) & ~e.own
            x = (e.r - rmin) / np.maximum(within - rmin, 1e-12)
            fade = np.where(near, np.where(x <= 0, 1.0, 0.5 * (np.cos(pi * x) + 1)) * self.weights(e.z, False), 0.0)
            kept, own = np.flatnonzero(near), e.centres()[near]
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            sums = []
            for j, values in enumerate(rotation_matrices(e.d[kept], self.rfac0 * pi * x[kept], top)):
                total = np.eye(j + 1, dtype=complex) * self.weights(e.zi, True)[:, None, None]
                if len(kept):
                    total[own[heads]] += np.add.reduceat(values * fade[kept, None, None], heads, axis=0)
                sums.append(total * (4 * pi / sqrt(j + 1) if self.normalize_U else 1.0))
            out = np.empty((len(e.zi), len(parts)))
            for at, (a, b, c) in enumerate(parts):
                # Couple rows with rows, then columns with columns, as two matrix products. A matrix turned by half a
                # turn is its conjugate but for signs, so the lower half of the rows adds what the upper half does.
                table, rows = tables[a, b, c], c // 2 + 1
                half = np.tensordot(sums[a], table[:, :, :rows], (1, 0)).transpose(0, 3, 1, 2).reshape(len(out), -1, b + 1) @ sums[b]
                product = half.reshape(len(out), rows, -1) @ table.reshape(-1, c + 1)
                twice = np.where(2 * np.arange(rows) == c, 1.0, 2.0)
                out[:, at] = (sums[c][:, :rows].conj() * product).sum(2).real @ twice
            return out

        return invariants


@dataclass(frozen=True)
class SO4(_Bispectrum):
    """Bispectrum on the three-sphere; atoms weigh their atomic number."""

    def weights(self, z: np.ndarray, centre: bool) -> np.ndarray:
        return z.astype(float)


@dataclass(frozen=True)
class SNAP(_Bispectrum):
    """Bispectrum with neighbours' weights by atomic number, ((z, weight), ...); others weigh 1, as do centres."""

    element_weights: tuple[tuple[int, float], ...] = ()
    rfac0 = 0.99363

    def weights(self, z: np.ndarray, centre: bool) -> np.ndarray:
        found = np.ones(len(z))
        for number, weight in () if centre else self.element_weights:
            found[z == number] = weight
        return found


@dataclass(frozen=True)
class LBispectrum(SNAP):
    """Bispectrum of order twojmax; diagonal keeps all couplings (0), equal first two (1), equal three (2) or third >= first (3).

    With element_radii, ((z, radius), ...), a pair's cutoff is the radii's sum times rcutfac and every atom needs a radius."""

    twojmax: int = 3
    diagonal: int = 3
    rfac0: float = 0.99363
    rmin0: float = 0.0
    rcutfac: float = 1.0
    element_radii: tuple[tuple[int, float], ...] = ()

    def __post_init__(self) -> None:
        super().__post_init__()
        require(self.twojmax >= 0 and self.diagonal in range(4), "twojmax is not negative, diagonal is 0 to 3", "diagonal")
        require(all(r > 0 for _, r in self.element_radii), "radii are positive", "element_radii")
        least = 2 * min((r for _, r in self.element_radii), default=self.rcut / 2) * (self.rcutfac if self.element_radii else 1)
        require(least > self.rmin0, "cutoffs are over rmin0", "rmin0")

    @property
    def reach(self) -> float:
        return 2 * max(r for _, r in self.element_radii) * self.rcutfac if self.element_radii else self.rcut

    @property
    def order(self) -> int:
        return self.twojmax

    def components(self) -> list[tuple[int, int, int]]:
        if self.diagonal == 2:
            return [(a, a, a) for a in range(self.order + 1)]
        couple = [(a, b, c) for a in range(self.order + 1) for b in range(a + 1) for c in range(a - b, min(self.order, a + b) + 1, 2)]
        return [p for p in couple if not (self.diagonal == 1 and p[0] != p[1]) and not (self.diagonal == 3 and p[2] < p[0])]

    def cutoffs(self, zi: np.ndarray, zj: np.ndarray) -> np.ndarray:
        if not self.element_radii:
            return super().cutoffs(zi, zj)
        numbers, radii = np.array(sorted(self.element_radii)).T
        missing = sorted(set(np.concatenate([zi, zj]).tolist()) - set(numbers.astype(int).tolist()))
        require(not missing, f"no radius for atomic numbers {missing}", "element_radii")
        return (radii[np.searchsorted(numbers, zi)] + radii[np.searchsorted(numbers, zj)]) * self.rcutfac
