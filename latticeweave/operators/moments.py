"""Moment tensor models in the text format of named assignments: parsing and evaluation over a block of centres."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .base import require
from .local import Edges


@dataclass(frozen=True)
class MomentModel:
    """basic: (radial function, powers of x, y, z) of each moment; times: (factor, factor, multiple, target)."""

    types: int
    min_dist: float
    max_dist: float
    scaling: float
    repulsive: bool
    radial: np.ndarray
    count: int
    basic: np.ndarray
    times: np.ndarray
    mapping: np.ndarray


def parse_moments(text: str) -> MomentModel:
    named = dict(re.findall(r"^\s*(\w+)\s*=\s*(.*?)\s*$", text, re.M))

    def number(name: str, kind=int, default=None):
        require(name in named or default is not None, f"{name} is missing", f"model.{name}")
        return kind(named.get(name, default))

    def table(name: str, columns: int) -> np.ndarray:
        require(name in named, f"{name} is missing", f"model.{name}")
        values = np.array([int(v) for v in re.findall(r"-?\d+", named[name])], dtype=int)
        require(len(values) % columns == 0, f"{name} has rows of {columns}", f"model.{name}")
        return values.reshape(-1, columns)

    types, size, functions = number("species_count"), number("radial_basis_size"), number("radial_funcs_count")
    kind = named.get("radial_basis_type", "")
    require(kind in ("RBChebyshev", "RBChebyshev_repuls"), "unknown radial basis", "model.radial_basis_type")
    radial = np.full((types, types, functions, size), np.nan)
    for first, second, block in re.findall(r"^\s*(\d+)-(\d+)\s*\n((?:\s*\{[^{}]*\})+)", text, re.M):
        rows = [[float(v) for v in row.split(",")] for row in re.findall(r"\{([^{}]*)\}", block)][:functions]
        require(max(int(first), int(second)) < types and np.shape(rows) == (functions, size), "radial coefficients have another shape", "model.radial_coeffs")
        radial[int(first), int(second)] = rows
    require(bool(np.isfinite(radial).all()), "radial coefficients are missing", "model.radial_coeffs")
    found = MomentModel(
        types, number("min_dist", float), number("max_dist", float), number("scaling", float, 1.0), kind.endswith("repuls"), radial,
        number("alpha_moments_count"), table("alpha_index_basic", 4), table("alpha_index_times", 4), table("alpha_moment_mapping", 1)[:, 0],
    )
    for name, values in (("basic", found.basic), ("times", found.times)):
        require(len(values) == number(f"alpha_index_{name}_count"), "counts and tables agree", f"model.alpha_index_{name}")
    ends = [found.basic.shape[0], *(found.times[:, [0, 1, 3]].ravel() + 1), *(found.mapping + 1)]
    require(max(ends) <= found.count and bool((found.basic[:, 0] < functions).all()), "indices are within the model's sizes", "model.alpha_moments_count")
    require(found.min_dist < found.max_dist, "distances have a range", "model.max_dist")
    return found


def moment_features(model: MomentModel) -> Callable[[Edges], np.ndarray]:
    """A constant one, then the model's scalars."""
    top = int(model.basic[:, 1:].max(initial=0))

    def features(e: Edges) -> np.ndarray:
        there = (e.r > 0) & (e.r <= model.max_dist) & ~e.own
        r = np.where(there, e.r, 1.0)
        q = np.maximum(r, model.min_dist) if model.repulsive else r
        x = (2 * q - model.min_dist - model.max_dist) / (model.max_dist - model.min_dist)
        cheb = np.polynomial.chebyshev.chebvander(x, model.radial.shape[3] - 1) * (model.scaling * (q - model.max_dist) ** 2 * there)[:, None]
        radial = np.einsum("efk,ek->ef", model.radial[e.ti[e.centres()], e.t], cheb)
        powers = (e.d / r[:, None])[:, :, None] ** np.arange(top + 1)
        moments = np.zeros((model.count, len(e.zi)))
        kinds, a, b, c = model.basic.T
        moments[: len(kinds)] = e.total(radial[:, kinds] * powers[:, 0, a] * powers[:, 1, b] * powers[:, 2, c]).T
        for first, second, multiple, target in model.times:
            moments[target] += multiple * moments[first] * moments[second]
        return np.concatenate([np.ones((len(e.zi), 1)), moments[model.mapping].T], axis=1)

    return features
