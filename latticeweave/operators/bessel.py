"""Power spectra in spherical Bessel functions, with smeared atoms and without each neighbour's product with itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import pi, sqrt

import numpy as np

from .base import require
from .local import Edges, _Local, harmonics, scaled_kummer

#: Width of the smooth step, and the length and power that damp far neighbours.
STEP, FAR, STEEP = 0.5, 2.0, 7


def spherical_bessel(x: np.ndarray, k: int) -> np.ndarray:
    """j_k as half the transform of a Legendre polynomial over [-1, 1]."""
    t, w = np.polynomial.legendre.leggauss(40 + k + int(np.max(np.abs(x), initial=0.0)))
    weights = w * np.polynomial.legendre.Legendre.basis(k)(t)
    return 0.5 * np.cos(np.multiply.outer(x, t) - k * pi / 2) @ weights


def bessel_zeros(top: int, count: int) -> list[np.ndarray]:
    """The first zeros of j_0 to j_top: each function's lie between those of the one before."""
    found = [pi * np.arange(1, count + top + 1)]
    for k in range(1, top + 1):
        low, high = found[-1][:-1].copy(), found[-1][1:].copy()
        sign = np.sign(spherical_bessel(low, k))
        for _ in range(60):
            middle = (low + high) / 2
            same = np.sign(spherical_bessel(middle, k)) == sign
            low, high = np.where(same, middle, low), np.where(same, high, middle)
        found.append((low + high) / 2)
    return [z[:count] for z in found]


def interpolated(function: Callable[[np.ndarray], np.ndarray], top: float, degree: int) -> Callable[[np.ndarray], np.ndarray]:
    """A smooth function's values (points, columns) on [0, top] by Chebyshev interpolation."""
    nodes = np.cos(pi * (np.arange(degree + 1) + 0.5) / (degree + 1))
    table = np.polynomial.chebyshev.chebvander(nodes, degree)
    coefficients = table.T @ function(top * (nodes + 1) / 2) * 2 / (degree + 1)
    coefficients[0] /= 2
    return lambda r: np.polynomial.chebyshev.chebvander(2 * r / top - 1, degree) @ coefficients


@dataclass(frozen=True)
class C00PSMLFF(_Local):
    """Sums of radial functions and products of expansion coefficients by channel pair; channels are (species, n).

    Radial functions are j_l with zeros at the cutoff, none above the last one of l = 0, so higher l have fewer.
    cutoff_function: bp (cosine), mo (cubic step), rj (step over half an Angstrom), wmc (that, damped). With
    exclude_self_interaction a neighbour of the centre's species loses its product with itself. super_vector weighs both
    parts by the roots of their weights and makes the whole a unit vector."""

    species: tuple[int, ...]
    r_cut: float = 6.0
    n_radial: int = 8
    l_max: int = 4
    cutoff_function: str = "bp"
    radial_sigma: float = 0.5
    include_radial: bool = True
    include_angular: bool = True
    normalize_radial: bool = False
    normalize_angular: bool = False
    super_vector: bool = False
    radial_weight: float = 1.0
    angular_weight: float = 1.0
    exclude_self_interaction: bool = True

    def __post_init__(self) -> None:
        require(self.r_cut > 0 and self.n_radial > 0 and self.l_max >= 0, "the cutoff and sizes are positive", "r_cut")
        require(self.cutoff_function in ("bp", "mo", "rj", "wmc"), "cutoff_function is bp, mo, rj or wmc", "cutoff_function")
        require(min(self.radial_sigma, self.radial_weight, self.angular_weight) >= 0, "widths and weights are not negative", "radial_sigma")
        require(self.include_radial or self.include_angular, "one part is included", "include_radial")
        roots = bessel_zeros(self.l_max, self.n_radial)
        limit = roots[0][-1] * (1 + 1e-12)
        object.__setattr__(self, "roots", [z[: max(1, int((z <= limit).sum()))] for z in roots])

    @property
    def reach(self) -> float:
        return self.r_cut

    def pairs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return np.triu_indices(len(self.species) * len(self.roots[k]))

    def labels(self) -> list[str]:
        channels = [[f"Z={z} n={n}" for z in self.species for n in range(len(roots))] for roots in self.roots]
        radial = [f"radial {c}" for c in channels[0]] if self.include_radial else []
        angular = [f"l={k} {c[a]} . {c[b]}" for k, c in enumerate(channels) for a, b in zip(*self.pairs(k))] if self.include_angular else []
        return radial + angular

    def fade(self, r: np.ndarray) -> np.ndarray:
        if self.cutoff_function == "bp":
            value = 0.5 * (np.cos(pi * r / self.r_cut) + 1)
        elif self.cutoff_function == "mo":
            x = np.clip(4 * r / self.r_cut - 3, -1, 1)
            value = (x - 1) ** 2 * (x + 2) / 4
        else:
            start = self.r_cut - STEP if self.r_cut > STEP else self.r_cut / 2
            # A cubic step in the squared distance from the start to the cutoff.
            x = (np.maximum(r, start) ** 2 - start**2) / (self.r_cut**2 - start**2)
            value = (1 - x) ** 2 * (1 + 2 * x)
            if self.cutoff_function == "wmc":
                value = value / (1 + (r / FAR) ** STEEP)
        return np.where(r <= self.r_cut, value, 0.0)

    def radial(self) -> list[Callable[[np.ndarray], np.ndarray]]:
        """Per l from distances to (edges, n), without the cutoff."""
        x, w = np.polynomial.legendre.leggauss(200)
        s, w = self.r_cut * (x + 1) / 2, w * self.r_cut / 2
        found = []
        for k, roots in enumerate(self.roots):
            norms = sqrt(self.r_cut**3 / 2) * np.abs(spherical_bessel(roots, k + 1))
            plain = lambda r, k=k, roots=roots, norms=norms: spherical_bessel(np.multiply.outer(r, roots) / self.r_cut, k) / norms
            if self.radial_sigma == 0:
                found.append(interpolated(plain, self.r_cut, 48 + int(roots[-1])))
                continue
            a, weighted = 0.5 / self.radial_sigma**2, plain(s) * (w * s * s)[:, None]

            def smeared(r, k=k, a=a, weighted=weighted):
                z = 2 * a * np.multiply.outer(r, s)
                bessel = scaled_kummer(k + 1.0, 2 * k + 2.0, 2 * z.ravel()).reshape(z.shape)
                for m in range(k):
                    bessel = bessel * z / (2 * m + 3)
                return 4 * pi * (a / pi) ** 1.5 * (bessel * np.exp(-a * (r[:, None] - s) ** 2)) @ weighted

            found.append(interpolated(smeared, self.r_cut, 48 + int(roots[-1] + 6 * self.r_cut / self.radial_sigma)))
        return found

    def kernel(self) -> Callable[[Edges], np.ndarray]:
        radial, types = self.radial(), len(self.species)

        def unit(part: np.ndarray) -> np.ndarray:
            norm = (part * part).sum(1, keepdims=True)
            return part / np.sqrt(np.where(norm > 1e-20, norm, 1.0))

        def features(e: Edges) -> np.ndarray:
            there = (e.r > 1e-12) & (e.r <= self.r_cut)
            fade, r = self.fade(e.r) * there, np.minimum(e.r, self.r_cut)
            own = (e.t == e.ti[e.centres()])[:, None]
            y, out = harmonics(e.d, self.l_max if self.include_angular else 0), []
            for k in range(self.l_max + 1 if self.include_angular else 1):
                g = radial[k](r) * fade[:, None]
                if k == 0 and self.include_radial:
                    part = e.by_type(g, types).reshape(len(e.zi), -1) / sqrt(4 * pi)
                    out.append(unit(part) if self.normalize_radial else part)
                if not self.include_angular:
                    break
                c = e.by_type(g[:, :, None] * y[:, None, k * k : (k + 1) ** 2], types).reshape(len(e.zi), -1, 2 * k + 1)
                power = c @ c.transpose(0, 2, 1)
                if self.exclude_self_interaction:
                    size = g.shape[1]
                    twice = e.total((g[:, :, None] * g[:, None, :]) * own[:, :, None]) * (2 * k + 1) / (4 * pi)
                    for t in range(types):
                        of = e.ti == t
                        power[of, t * size : (t + 1) * size, t * size : (t + 1) * size] -= twice[of]
                a, b = self.pairs(k)
                count = len(self.roots[k])
                out.append(power[:, a, b] * np.where(a % count == b % count, 1.0, sqrt(2)) * sqrt(8 * pi * pi / (2 * k + 1)))
            if self.include_angular:
                first = 1 if self.include_radial else 0
                whole = np.concatenate(out[first:], axis=1)
                out = [*out[:first], unit(whole) if self.normalize_angular else whole]
            if self.super_vector:
                weights = [self.radial_weight] * self.include_radial + [self.angular_weight] * self.include_angular
                return unit(np.concatenate([p * sqrt(w) for p, w in zip(out, weights)], axis=1))
            return np.concatenate(out, axis=1)

        return features
