"""Atomic cluster expansion: products of one-particle sums that no rotation and no exchange of neighbours changes.

A product's magnetic indices run over tuples that sum to zero; its invariants are the tuples' combinations that the
raising operator sends to zero. Those are made symmetric under exchanges of factors of equal species, n and l. Within
one product they are unique up to a rotation among themselves, so single columns have no meaning beyond their product's
norm; the largest coefficient of each is made positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import permutations, product
from math import sqrt

import numpy as np

from .base import require
from .local import Edges, _Local, harmonics

#: Midpoints on which the radial polynomials are orthonormal, and the share of the greatest eigenvalue that counts.
MIDPOINTS, RANK = 1000, 1e-7
#: Products of this many terms are held at once for a block of centres.
TERMS = 4096


@cache
def invariants(angular: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Magnetic indices (tuples, factors) that sum to zero, and orthonormal invariants (rows, tuples)."""
    every = np.array([m for m in product(*[range(-k, k + 1) for k in angular]) if sum(m) == 0])
    raised: dict[tuple[int, ...], int] = {}
    entries = []
    for column, m in enumerate(every.tolist()):
        for at, (k, one) in enumerate(zip(angular, m)):
            if one < k:
                target = (*m[:at], one + 1, *m[at + 1 :])
                entries.append((raised.setdefault(target, len(raised)), column, sqrt((k - one) * (k + one + 1))))
    matrix = np.zeros((max(1, len(raised)), len(every)))
    for row, column, value in entries:
        matrix[row, column] += value
    values, vectors = np.linalg.eigh(matrix.T @ matrix)
    return every, vectors[:, values < 1e-9 * max(1.0, values[-1])].T


def symmetric(factors: tuple[tuple[int, int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Magnetic indices and invariants (rows, tuples) of a product of (species, n, l)."""
    every, basis = invariants(tuple(f[2] for f in factors))
    if len(factors) == 1 or not len(basis):
        return every, basis
    place = {tuple(m): k for k, m in enumerate(every.tolist())}
    gram = np.zeros((len(basis), len(basis)))
    for order in permutations(range(len(factors))):
        if all(factors[p] == f for p, f in zip(order, factors)):
            gram += basis @ basis[:, [place[tuple(m[p] for p in order)] for m in every.tolist()]].T
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > RANK * max(1.0, values[-1])  # a matrix of rounding errors alone has no invariant
    rows = (vectors[:, keep] * np.sqrt(values[keep])).T @ basis
    first = np.abs(rows).argmax(1)
    return every, rows * np.sign(rows[np.arange(len(rows)), first])[:, None]


@dataclass(frozen=True)
class ACE(_Local):
    """Invariant products of up to N one-particle sums, each over (species, n from 1, l).

    Distances become t = ((a + r0) / (a + r))^p; radial functions are polynomials of t times (t - t_cut)^pcut
    (t - t_in)^pin. A product's degree is csp times the sum of its factors' n + wL l, plus chc times the product of
    max(ahc, bhc + degree), and at most maxdeg; with a maxdeg and wL per order it is the sum alone. rin is half r0 if
    not given."""

    species: tuple[int, ...]
    N: int = 3
    r0: float = 2.5
    p: float = 2.0
    a: float = 1.0
    wL: float | tuple[float, ...] = 1.5
    maxdeg: float | tuple[float, ...] = 8.0
    csp: float = 1.0
    chc: float = 0.0
    ahc: float = 0.0
    bhc: float = 0.0
    rcut: float = 5.0
    rin: float | None = None
    pcut: int = 2
    pin: int = 2
    constants: bool = False

    def __post_init__(self) -> None:
        require(self.N >= 1 and self.p != 0 and self.a + self.r0 > 0, "N is positive, the transform has a power", "N")
        require(0 <= self.inner < self.rcut and min(self.pcut, self.pin) >= 0, "0 <= rin < rcut, powers are not negative", "rin")
        by_order = isinstance(self.maxdeg, (tuple, list))
        require(by_order == isinstance(self.wL, (tuple, list)) and (not by_order or len(self.maxdeg) == len(self.wL) == self.N), "maxdeg and wL are numbers or have one per order", "maxdeg")
        require(min(self.limit(1), self.weight(1), self.limit(self.N), self.weight(self.N)) > 0 and min(self.csp, self.chc, self.ahc, self.bhc) >= 0, "degrees are positive", "maxdeg")

    @property
    def inner(self) -> float:
        return self.r0 / 2 if self.rin is None else self.rin

    @property
    def reach(self) -> float:
        return self.rcut

    @property
    def keeps_self(self) -> bool:
        """The constant holds for atoms without neighbours, too."""
        return self.constants

    def limit(self, order: int) -> float:
        return self.maxdeg[order - 1] if isinstance(self.maxdeg, (tuple, list)) else self.maxdeg

    def weight(self, order: int) -> float:
        return self.wL[order - 1] if isinstance(self.wL, (tuple, list)) else self.wL

    def radial_size(self) -> int:
        return max(1, int(np.ceil(self.limit(1) - 1e-12)))

    def single(self) -> list[tuple[int, int, int]]:
        """(species, n, l) of the one-particle sums."""
        top, w = self.radial_size(), self.weight(1)
        return [(s, n, k) for s in range(len(self.species)) for n in range(1, top + 1) for k in range(int((top - n) / w + 1e-12 / w) + 1)]

    def products(self) -> Iterator[tuple[tuple[int, int, int], ...]]:
        """Ordered by number of factors, then by factors."""
        single, plain = self.single(), not isinstance(self.maxdeg, (tuple, list))

        def grow(order: int, chosen: tuple, start: int, total: float, across: float):
            if len(chosen) == order:
                if (order == 1 and chosen[0][2] == 0) or (order > 1 and sum(f[2] for f in chosen) % 2 == 0):
                    yield chosen
                return
            for at in range(start, len(single)):
                degree = single[at][1] + self.weight(order) * single[at][2]
                sums, times = total + degree, across * max(self.ahc, self.bhc + degree)
                # Degrees are at least one, so both parts only grow.
                found = self.csp * sums + self.chc * times if plain else sums
                if found <= self.limit(order) * (1 if plain else 1 + 1e-12) + (1e-12 if plain else 0):
                    yield from grow(order, (*chosen, single[at]), at, sums, times)

        if self.constants:
            yield ()
        for order in range(1, self.N + 1):
            yield from grow(order, (), 0, 0.0, 1.0)

    def expansion(self) -> list[tuple[tuple, np.ndarray, np.ndarray]]:
        """(factors, magnetic indices, one invariant's coefficients), built once per process."""
        return _expansion(self)

    def labels(self) -> list[str]:
        return [" ".join(f"({self.species[s]} n={n} l={k})" for s, n, k in factors) or "constant" for factors, _, _ in self.expansion()]

    def transformed(self, r: np.ndarray) -> np.ndarray:
        return ((self.a + self.r0) / (self.a + r)) ** self.p

    def radial(self) -> Callable[[np.ndarray], np.ndarray]:
        """From distances to (edges, n): orthonormal on midpoints, leading coefficients positive."""
        ends = sorted([(float(self.transformed(np.array(self.rcut))), self.pcut), (float(self.transformed(np.array(self.inner))), self.pin)])
        (low, first), (high, second) = ends
        require(high > low, "the transform tells the cutoffs apart", "rin")
        size = self.radial_size()

        def raw(t: np.ndarray) -> np.ndarray:
            inside = ((t >= low) | (first == 0)) & ((t <= high) | (second == 0))
            envelope = np.where(inside, (t - low) ** first * (t - high) ** second, 0.0)
            return envelope[:, None] * np.polynomial.legendre.legvander((2 * t - low - high) / (high - low), size - 1)

        t = low + (high - low) * (np.arange(MIDPOINTS) + 0.5) / MIDPOINTS
        triangle = np.linalg.qr(raw(t) / sqrt(MIDPOINTS))[1]
        mixing = np.linalg.inv(triangle) * np.sign(np.diag(triangle))
        return lambda r: raw(self.transformed(r)) @ mixing

    def kernel(self) -> Callable[[Edges], np.ndarray]:
        radial, single, expansion = self.radial(), self.single(), self.expansion()
        top = max(k for _, _, k in single)
        channel, columns = {}, []
        for s, n, k in single:
            for m in range(-k, k + 1):
                channel[s, n, k, m] = len(columns)
                columns.append((s, n - 1, k * k + k + m))
        kinds, numbers, places = np.array(columns).T
        jobs, terms = [], 0
        for at, (factors, every, row) in enumerate(expansion):
            used = np.abs(row) > 1e-15
            index = np.array([[channel[(*f, int(m))] for f, m in zip(factors, ms)] for ms in every[used]], dtype=int).reshape(int(used.sum()), len(factors))
            if not jobs or jobs[-1][0] != len(factors) or terms + len(index) > TERMS:
                jobs.append((len(factors), at, [], [], []))
                terms = 0
            jobs[-1][2].append(index)
            jobs[-1][3].append(row[used])
            jobs[-1][4].append(terms)
            terms += len(index)
        jobs = [(at, np.concatenate(i), np.concatenate(c), np.array(starts)) for _, at, i, c, starts in jobs]

        def features(e: Edges) -> np.ndarray:
            there = (e.r > 0) & ~e.own
            g, real = radial(e.r) * there[:, None], harmonics(e.d, top)
            y = real.astype(complex)
            for k in range(1, top + 1):
                for m in range(1, k + 1):
                    both = (real[:, k * k + k + m] + 1j * real[:, k * k + k - m]) / sqrt(2)
                    y[:, k * k + k + m], y[:, k * k + k - m] = (-1) ** m * both, both.conj()
            sums = e.by_type(g[:, :, None] * y[:, None, :], len(self.species))[:, kinds, numbers, places]
            out = np.empty((len(sums), len(expansion)))
            for at, index, coefficients, starts in jobs:
                values = np.ones((len(sums), len(index)), complex)
                for factor in range(index.shape[1]):
                    values = values * sums[:, index[:, factor]]
                out[:, at : at + len(starts)] = np.add.reduceat((values * coefficients).real, starts, axis=1)
            return out

        return features


@cache
def _expansion(operator: ACE) -> list[tuple[tuple, np.ndarray, np.ndarray]]:
    found = []
    for factors in operator.products():
        every, rows = symmetric(factors) if factors else (np.zeros((1, 0), int), np.ones((1, 1)))
        found += [(factors, every, row) for row in rows]
    return found
