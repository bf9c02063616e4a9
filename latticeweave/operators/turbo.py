"""Smooth overlap spectra with separable radial and angular widths that may grow with distance.

Radial functions are powers of the distance to the hard cutoff (unit length), from the third on, and optionally a
Gaussian at the origin. Their products with an atom's Gaussian are moments over [0, soft] and, damped, over [soft, 1].
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import pi, sqrt

import numpy as np

from ..functions.special import erf, smooth
from .base import require
from .local import Edges, _Local, harmonics, inverse_root, scaled_kummer

#: Spectra shorter than this are not made unit vectors.
FLOOR = 1e-5


def moments(centre: np.ndarray, width: np.ndarray, low: float, high: float, count: int) -> np.ndarray:
    """(points, count): sqrt(2k+5) times the integrals over [low, high] of (1 - x)^(k+2) exp(-(x - centre)^2 / 2 width^2), k from 1.

    By parts, each from the two before. By convention the bound at 1 adds nothing, not even to the first power."""
    square = width**2
    at = lambda x: square * np.exp(-((x - centre) ** 2) / (2 * square))
    upper = at(high) if high < 1 else np.zeros_like(centre)
    lower, root = at(low), sqrt(2) * width
    found = [np.zeros_like(centre), sqrt(pi / 2) * width * (erf((high - centre) / root) - erf((low - centre) / root))]
    for k in range(count + 2):
        found.append((1 - centre) * found[-1] + k * square * found[-2] + upper * (1 - high) ** k - lower * (1 - low) ** k)
    return np.stack([sqrt(2 * k + 5) * found[k + 3] for k in range(1, count + 1)], 1) if count else np.zeros((len(centre), 0))


def overlaps(count: int, origin: float | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Gram matrix of the radial functions, the last one a Gaussian of width origin at 0 if given; and its column."""
    powers = count - (origin is not None)
    k = 2.0 * np.arange(1, powers + 1) + 5
    gram = np.eye(count)
    gram[:powers, :powers] = 2 * np.sqrt(k[:, None] * k) / (k[:, None] + k)
    if origin is None:
        return gram, None
    column = np.ones(count)
    column[:-1] = moments(np.zeros(1), np.array([origin]), 0.0, 1.0, powers)[0] * sqrt(2 / origin) / pi**0.25
    gram[-1], gram[:, -1] = column, column
    return gram, column


@dataclass(frozen=True)
class SOAPTurbo(_Local):
    """Power spectra by unordered channel pair and l, made unit vectors; channels are (species, n).

    alpha_max and the widths, scalings and central_weight are one value or one per species. compression: off, trivial
    (pairs with a species' first channel) or a_b, a the radial and b the species indices kept (0 to 2 of the two), the
    others summed. Atoms that are not of central_species have zeros."""

    species: tuple[int, ...]
    alpha_max: int | tuple[int, ...] = 8
    l_max: int = 6
    rcut_hard: float = 5.0
    rcut_soft: float | None = None
    nf: float = 1.0
    radial_enhancement: int = 0
    basis: str = "poly3"
    compression: str = "off"
    atom_sigma_r: float | tuple[float, ...] = 0.5
    atom_sigma_r_scaling: float | tuple[float, ...] = 0.0
    atom_sigma_t: float | tuple[float, ...] = 0.5
    atom_sigma_t_scaling: float | tuple[float, ...] = 0.0
    amplitude_scaling: float | tuple[float, ...] = 0.0
    central_weight: float | tuple[float, ...] = 1.0
    central_species: tuple[int, ...] | None = None
    keeps_self = True

    def __post_init__(self) -> None:
        require(0 <= self.l_max <= 20 and 0 < self.soft <= 1 and self.rcut_hard > 0 and self.nf > 0, "l_max is 0 to 20, the soft cutoff is in the hard one", "rcut_soft")
        require(self.basis in ("poly3", "poly3gauss") and self.radial_enhancement in (0, 1, 2), "basis is poly3 or poly3gauss, enhancement 0 to 2", "basis")
        top = 10 if self.basis == "poly3" else 11
        counts = self.each("alpha_max")
        require(all(0 < a <= top for a in counts), f"alpha_max is 1 to {top}", "alpha_max")
        for name in ("atom_sigma_r", "atom_sigma_t"):
            ends = [(s, s + g * self.rcut_hard) for s, g in zip(self.each(name), self.each(f"{name}_scaling"))]
            require(all(a > 0 and b > 0 for a, b in ends), "widths stay positive up to the cutoff", name)
        require(all(a >= 0 for a in self.each("amplitude_scaling")) and len(self.each("central_weight")) > 0, "scalings are not negative", "amplitude_scaling")
        modes = ("off", "trivial", *[f"{a}_{b}" for a in range(3) for b in range(3)])
        require(self.compression in modes and (self.compression in modes[:2] or len(set(counts)) == 1), "unknown compression, or alpha_max differs", "compression")
        require(set(self.central_species or ()) <= set(self.species), "central species are declared", "central_species")

    def each(self, name: str) -> tuple:
        value = getattr(self, name)
        found = tuple(value) if isinstance(value, (tuple, list)) else (value,) * len(self.species)
        require(len(found) == len(self.species), "a value per species", name)
        return found

    @property
    def soft(self) -> float:
        return (self.rcut_hard if self.rcut_soft is None else self.rcut_soft) / self.rcut_hard

    @property
    def reach(self) -> float:
        return self.rcut_hard

    def channels(self) -> list[tuple[int, int]]:
        return [(t, n) for t, count in enumerate(self.each("alpha_max")) for n in range(count)]

    def recipe(self) -> tuple[list[str], np.ndarray]:
        """Names of the kept channel pairs and their weights (kept, pairs)."""
        channels = self.channels()
        first, second = np.triu_indices(len(channels))
        pairs = [(channels[a], channels[b]) for a, b in zip(first, second)]
        name = lambda c: " ".join([f"Z={self.species[c[0]]}" if c[0] is not None else "Z=all", f"n={c[1]}" if c[1] is not None else "n=all"])
        if self.compression in ("off", "trivial"):
            kept = [k for k, (a, b) in enumerate(pairs) if self.compression == "off" or 0 in (a[1], b[1])]
            return [f"{name(pairs[k][0])} . {name(pairs[k][1])}" for k in kept], np.eye(len(pairs))[kept]
        radial, kinds = (int(v) for v in self.compression.split("_"))
        key = lambda c, slot: (c[0] if kinds > slot else None, c[1] if radial > slot else None)
        slots = [list(dict.fromkeys(key(c, slot) for c in channels)) for slot in (0, 1)]
        ordered = radial % 2 or kinds % 2
        if ordered:
            names = [(a, b) for a in slots[0] for b in slots[1]]
        else:
            names = [(a, b) for k, a in enumerate(slots[0]) for b in slots[0][k:]]
        at, weights = {n: k for k, n in enumerate(names)}, np.zeros((len(names), len(pairs)))
        for k, (a, b) in enumerate(pairs):
            ways = [(key(a, 0), key(b, 1)), (key(b, 0), key(a, 1))]
            if not ordered:
                x, y = sorted((slots[0].index(key(c, 0)) for c in (a, b)))
                weights[at[slots[0][x], slots[0][y]], k] += sqrt(2) if a != b and x == y else 1.0
            elif a == b:
                weights[at[ways[0]], k] += 1.0
            else:
                for way in ways:
                    weights[at[way], k] += sqrt(0.5)
        return [f"{name(a)} . {name(b)}" for a, b in names], weights

    def labels(self) -> list[str]:
        return [f"{n} l={k}" for n in self.recipe()[0] for k in range(self.l_max + 1)]

    def radial(self, t: int) -> tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], np.ndarray | None]:
        """Of one species: from distances and whether they are the centre to (edges, n), and the origin's coefficients."""
        of = lambda name: self.each(name)[t]
        count, sigma, soft = of("alpha_max"), of("atom_sigma_r") / self.rcut_hard, self.soft
        origin = sigma if self.basis == "poly3gauss" else None
        gram, column = overlaps(count, origin)
        root, powers = inverse_root(gram), count - (origin is not None)

        def find(r: np.ndarray, own: np.ndarray) -> np.ndarray:
            x = r / self.rcut_hard
            width = sigma + of("atom_sigma_r_scaling") * x
            size = np.where(own, of("central_weight"), 1.0) / width
            if of("amplitude_scaling"):
                fade = 1 + 2 * x**3 - 3 * x**2
                size = np.where(fade > 1e-10, size * np.maximum(fade, 1e-10) ** of("amplitude_scaling"), 0.0)
            if self.radial_enhancement == 1:
                size = size * (x + sqrt(2 / pi) * width)
            elif self.radial_enhancement == 2:
                size = size * (x**2 + width**2 + sqrt(8 / pi) * width * x)
            values = np.zeros((len(r), count))
            values[:, :powers] = moments(x, width, 0.0, soft, powers)
            if soft < 1:
                square, edge = width**2, ((1 - soft) / self.nf) ** 2
                damping = np.where(soft - x < 4 * width, np.exp(-((soft - x) ** 2) / (2 * (square + edge))), 0.0)
                centre, narrow = (square * soft + edge * x) / (square + edge), np.sqrt(square * edge / (square + edge))
                values[:, :powers] += damping[:, None] * moments(centre, narrow, soft, 1.0, powers)
            if origin is not None:
                both = np.sqrt(origin**2 + width**2)
                values[:, -1] = np.exp(-(x**2) / (2 * both**2)) * sqrt(pi / 2) * width * origin / both * (1 + erf(origin / width * x / (sqrt(2) * both))) * sqrt(2 / origin) / pi**0.25
                size = np.where(own, 0.0, size)
            return (values * (size * (x < 1))[:, None]) @ root * sqrt(self.rcut_hard)

        if origin is None:
            return find, None
        wide = of("atom_sigma_r")
        enhanced = (1.0, sqrt(2 / pi) * sigma, sigma**2)[self.radial_enhancement]
        front = enhanced * of("central_weight") * sqrt(4 * pi) * pi**0.25 * sqrt(wide / 2) * self.rcut_hard**3 / (of("atom_sigma_t") ** 2 * wide)
        return find, front * root @ column

    def kernel(self) -> Callable[[Edges], np.ndarray]:
        radial, weights = [self.radial(t) for t in range(len(self.species))], self.recipe()[1]
        first, second = np.triu_indices(len(self.channels()))
        twice = np.where(first == second, 1.0, sqrt(2))
        sigma, growth = (np.array(self.each(n)) for n in ("atom_sigma_t", "atom_sigma_t_scaling"))
        allowed = np.array([self.central_species is None or s in self.central_species for s in self.species])

        def turning(t: int) -> Callable[[np.ndarray], np.ndarray]:
            def plain(r: np.ndarray) -> np.ndarray:
                width, out = sigma[t] + growth[t] * r, []
                z, front = (r / width) ** 2, 4 * pi * (self.rcut_hard / width) ** 2
                for k in range(self.l_max + 1):
                    front = front * z / (2 * k + 1) if k else front
                    out.append(front * scaled_kummer(k + 1.0, 2 * k + 2.0, 2 * z))
                return np.stack(out, 1)

            return smooth(plain, self.rcut_hard)

        turns = [turning(t) for t in range(len(self.species))]
        # Pairs kept as they are need no product with their weights.
        picked = weights.argmax(1) if self.compression in ("off", "trivial") else None

        def spectrum(e: Edges) -> np.ndarray:
            y, parts = harmonics(e.d, self.l_max), []
            for t, (find, origin) in enumerate(radial):
                of, c = np.flatnonzero(e.t == t), np.zeros((len(e.zi), self.each("alpha_max")[t], y.shape[1]))
                if len(of):
                    g, turned, r = find(e.r[of], e.own[of]), y[of], np.minimum(e.r[of], self.rcut_hard)
                    for k, v in enumerate(turns[t](r).T):
                        turned[:, k * k : (k + 1) ** 2] *= v[:, None]
                    own = e.centres()[of]
                    heads = np.flatnonzero(np.diff(own, prepend=-1))
                    c[own[heads]] = np.add.reduceat(g[:, :, None] * turned[:, None, :], heads, axis=0)
                if origin is not None:
                    c[e.ti == t, :, 0] += origin
                parts.append(c)
            # Centres come last, where products run over them without a gap.
            c = np.ascontiguousarray(np.moveaxis(np.concatenate(parts, axis=1), 0, -1))
            blocks = [c[:, k * k : (k + 1) ** 2] for k in range(self.l_max + 1)]
            power = np.stack([np.einsum("pmx,qmx->pqx", b, b)[first, second] * twice[:, None] for b in blocks], 1)
            kept = np.tensordot(weights, power, (1, 0)) if picked is None else power[picked]
            found = kept.reshape(-1, c.shape[-1]).T * allowed[e.ti][:, None]
            norm = np.sqrt((found * found).sum(1, keepdims=True))
            return found / np.where(norm < FLOOR, 1.0, norm)

        return spectrum
