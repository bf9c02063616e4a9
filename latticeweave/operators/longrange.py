"""Expansion of a periodic structure's long-range density about each atom, in reciprocal space.

Structures stream to Python whole, where those of one cell share their waves and radial functions. Of structures of too
many atoms for that, waves of a half space are rows from sequences; structure factors by species are sums over the atoms; a
structure's waves then meet its atoms in runs of RUN, so that one task holds one run and one structure's waves.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from math import erfc, exp, gamma, log, pi, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.edges import _inverse
from ..plans.gathered import Run, batch, inverses, kinds, lists, mapped, runs, volumes
from .base import Operator, require, type_index
from .bessel import interpolated, spherical_bessel
from .local import KEYS, cells, harmonics, inverse_root

RUN = 256
#: Values of atoms, species and waves held at once; a structure is never cut.
PIECE = 1 << 18
EULER = 0.5772156649015329


def exponential_integral(order: float, x: float) -> float:
    """E_order(x), x > 0, for whole and half orders: upward recurrence below 1, else a continued fraction."""
    if x < 1:
        k = order % 1.0 or 1.0
        value = sqrt(pi / x) * erfc(sqrt(x)) if k == 0.5 else -EULER - log(x) - sum(_terms(x))
        if order == 0:
            return exp(-x) / x
        while k < order:
            value, k = (exp(-x) - x * value) / k, k + 1
        return value
    tail = 0.0
    for i in range(400, 0, -1):
        tail = -i * (order - 1 + i) / (x + order + 2 * i + tail)
    return exp(-x) / (x + order + tail)


def _terms(x: float):
    power = 1.0
    for k in range(1, 40):
        power *= -x / k
        yield power / k


@dataclass(frozen=True)
class LodeSphericalExpansion(Operator):
    """Coefficients by centre species, neighbour species, l, m, n of densities that fall with distance^-exponent."""

    species: tuple[int, ...]
    cutoff: float = 6.0
    density_width: float = 0.3
    max_radial: int = 6
    max_angular: int = 4
    k_cutoff: float = 2.5
    exponent: int = 1
    radial_radius: float | None = None
    periodic_only = True

    def __post_init__(self) -> None:
        require(self.cutoff > 0 and self.density_width > 0 and self.k_cutoff > 0 and (self.radial_radius or 1) > 0, "cutoffs and widths are positive", "cutoff")
        require(self.max_radial >= 0 and self.max_angular >= 0, "sizes are not negative", "max_radial")
        require(self.exponent in range(1, 10), "the exponent is 1 to 9", "exponent")

    def labels(self) -> list[str]:
        return [f"Z={a},{b} l={k} m={m} n={n}" for a in self.species for b in self.species for k in range(self.max_angular + 1) for m in range(-k, k + 1) for n in range(self.max_radial + 1)]

    def density(self, k: float) -> float:
        """Transform of a smeared density at a wave's length."""
        p, square = self.exponent, self.density_width**2
        return pi**1.5 * (2 * square) ** ((3 - p) / 2) / gamma(p / 2) * exponential_integral((p - 1) / 2, k * k * square / 2)

    def radial(self, k: np.ndarray) -> np.ndarray:
        """(waves, (max_angular+1) * radial): spherical Bessel transforms of the orthonormal Gaussian-type functions."""
        size, radius = self.max_radial + 1, self.radial_radius or self.cutoff
        n = np.arange(size)
        widths = radius * np.maximum(np.sqrt(n), 1.0) / size
        x, w = np.polynomial.legendre.leggauss(300)
        r, w = 9 * widths.max() * (x + 1), w * 9 * widths.max()
        raw = r ** n[:, None] * np.exp(-(r**2) / (2 * widths[:, None] ** 2))
        raw /= np.sqrt((raw**2 * r * r) @ w)[:, None]
        basis = inverse_root((raw * r * r * w) @ raw.T) @ raw * (r * r * w)
        return np.concatenate([spherical_bessel(np.multiply.outer(k, r), m) @ basis.T for m in range(self.max_angular + 1)], axis=1)

    def waves(self, structures: DataFrame) -> DataFrame:
        """structure_id, volume, kx, ky, kz: one of each opposite pair, shorter than the cutoff."""
        cell = lambda r, c: F.get("cell", F.lit(3 * r + c))
        bound = lambda k: F.ceil(self.k_cutoff / (2 * pi) * F.sqrt(sum((cell(k, c) ** 2 for c in range(3)), F.lit(0.0)))).cast("int")
        det = sum((cell(0, c) * (cell(1, (c + 1) % 3) * cell(2, (c + 2) % 3) - cell(1, (c + 2) % 3) * cell(2, (c + 1) % 3)) for c in range(3)), F.lit(0.0))
        found = structures.select("structure_id", F.abs(det).alias("volume"), F.array(*_inverse(F.col("cell"))).alias("inverse"), *[bound(k).alias(f"b{k}") for k in range(3)])
        for k in range(3):
            found = found.select("*", F.explode(F.sequence(F.lit(0) if k == 0 else -F.col(f"b{k}"), F.col(f"b{k}"))).alias(f"n{k}"))
        ahead = (F.col("n0") > 0) | ((F.col("n0") == 0) & ((F.col("n1") > 0) | ((F.col("n1") == 0) & (F.col("n2") > 0))))
        wave = lambda c: 2 * pi * sum((F.col(f"n{k}") * F.get("inverse", F.lit(3 * c + k)) for k in range(3)), F.lit(0.0))
        found = found.where(ahead).select("structure_id", "volume", *[wave(c).alias(n) for c, n in enumerate(("kx", "ky", "kz"))])
        return found.where(F.col("kx") ** 2 + F.col("ky") ** 2 + F.col("kz") ** 2 < self.k_cutoff**2)

    def factors(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        """structure_id, volume, waves: a struct (kx, ky, kz, c, s) per wave, c and s sums over atoms by species."""
        phase = F.col("kx") * F.col("x") + F.col("ky") * F.col("y") + F.col("kz") * F.col("zc")
        typed = atoms.withColumn("t", type_index(F.col("z"), self.species)).join(self.waves(structures), "structure_id").withColumn("phase", phase)
        part = lambda f, k: F.sum(F.when(F.col("t") == k, f("phase")).otherwise(0.0))
        every = range(len(self.species))
        sums = typed.groupBy("structure_id", "volume", "kx", "ky", "kz").agg(F.array(*[part(F.cos, k) for k in every]).alias("c"), F.array(*[part(F.sin, k) for k in every]).alias("s"))
        return sums.groupBy("structure_id", "volume").agg(F.collect_list(F.struct("kx", "ky", "kz", "c", "s")).alias("waves"))

    def compute(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        self.check(structures)
        rest = lambda above: self.gathered(structures, above)
        return mapped(structures, atoms, partial(_streamed, self, False), "structure_id long, atom_index int, features array<double>", rest)

    def gathered(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        """compute() of large structures."""
        atom = F.struct("atom_index", type_index(F.col("z"), self.species).alias("t"), "x", "y", "zc")
        runs = atoms.groupBy("structure_id", F.floor(F.col("atom_index") / RUN).alias("run")).agg(F.collect_list(atom).alias("atoms"))
        found = runs.join(self.factors(structures, atoms), "structure_id", "left")
        waves = F.coalesce("waves", F.raise_error(F.lit("a structure has no wave below k_cutoff")))
        return found.select("structure_id", "volume", "atoms", waves.alias("waves")).mapInArrow(partial(_expand, self), "structure_id long, atom_index int, features array<double>")

    def plan(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        self.check(structures)
        rest = lambda above: self.gathered(structures, above).select(*KEYS, F.posexplode("features").alias("feature", "value")).where("value <> 0")
        return mapped(structures, atoms, partial(_streamed, self, True), "structure_id long, atom_index int, feature int, value double", rest)

    def shared(self, radial, cell: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Waves of a cell, and for even and odd momenta the weighted products of harmonics and radial functions with
        their signs: (waves, harmonics * radial), zero in the other half."""
        inverse = inverses(cell[None], np.array([True]))[0]
        bounds = np.ceil(self.k_cutoff / (2 * pi) * np.sqrt((cell**2).sum(1))).astype(int)
        n = np.stack(np.meshgrid(*[np.arange(-b, b + 1) for b in bounds], indexing="ij"), -1).reshape(-1, 3)
        k = 2 * pi * n[len(n) // 2 + 1 :] @ inverse.T
        k = k[(k * k).sum(1) < self.k_cutoff**2]
        if not len(k):
            raise ValueError("a structure has no wave below k_cutoff")
        top, size, length = self.max_angular, self.max_radial + 1, np.sqrt((k * k).sum(1))
        weight = 8 * pi / volumes(cell[None])[0] * np.array([self.density(v) for v in length])
        transforms, y = radial(length).reshape(len(k), top + 1, size), harmonics(k, top)
        tables = [np.zeros((len(k), (top + 1) ** 2, size)) for _ in range(2)]
        for m in range(top + 1):
            # The real part of i^m (a + ib) is a, -b, -a, b.
            of = slice(m * m, (m + 1) ** 2)
            tables[m % 2][:, of] = (1, -1, -1, 1)[m % 4] * y[:, of, None] * transforms[:, None, m] * weight[:, None, None]
        return k, [t.reshape(len(k), -1) for t in tables]

    def expanded(self, k: np.ndarray, tables: list[np.ndarray], of: np.ndarray, t: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(atoms, species * harmonics * radial) of whole structures of one cell; of: each atom's structure, ascending."""
        types, wave = len(self.species), np.exp(1j * (at @ k.T))
        key = of * types + t
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.diff(key[order], prepend=-1))
        factors = np.zeros(((of[-1] + 1) * types, len(k)), complex)
        factors[key[order][heads]] = np.add.reduceat(wave[order], heads, axis=0).conj()
        shifted = (wave[:, None] * factors.reshape(-1, types, len(k))[of]).reshape(-1, len(k))
        return (np.ascontiguousarray(shifted.real) @ tables[0] + np.ascontiguousarray(shifted.imag) @ tables[1]).reshape(len(at), -1)

    def coefficients(self, radial, volume: float, k: np.ndarray, c: np.ndarray, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(atoms, species, harmonics, radial) at positions."""
        top, size, length = self.max_angular, self.max_radial + 1, np.sqrt((k * k).sum(1))
        weight = 8 * pi / volume * np.array([self.density(v) for v in length])
        phase = at @ k.T
        shifted = np.exp(1j * phase)[:, None, :] * (c - 1j * s).T * weight
        transforms, y, out = radial(length).reshape(len(k), top + 1, size), harmonics(k, top), []
        for m in range(top + 1):
            out.append(np.einsum("itk,kh,kn->ithn", (shifted * 1j**m).real, y[:, m * m : (m + 1) ** 2], transforms[:, m], optimize=True))
        return np.concatenate(out, axis=2)


def _expand(operator: LodeSphericalExpansion, batches):
    import pyarrow as pa

    radial, types = _radial(operator), len(operator.species)
    for batch in batches:
        for row in range(batch.num_rows):
            at, waves = batch.column("atoms")[row].values, batch.column("waves")[row].values
            get = lambda of, name: of.field(name).to_numpy(zero_copy_only=False)
            lists = lambda name: waves.field(name).flatten().to_numpy().reshape(-1, types)  # noqa: B023, E731
            stack = lambda of, names: np.stack([get(of, n) for n in names], 1)
            found = operator.coefficients(radial, batch.column("volume")[row].as_py(), stack(waves, ("kx", "ky", "kz")), lists("c"), lists("s"), stack(at, ("x", "y", "zc")))
            own = get(at, "t")
            placed = np.zeros((len(own), types, *found.shape[1:]))
            placed[np.arange(len(own)), own] = found
            ends = np.arange(len(own) + 1, dtype=np.int32) * placed[0].size
            features = pa.ListArray.from_arrays(pa.array(ends), pa.array(placed.ravel()))
            ids = pa.array(np.full(len(own), batch.column("structure_id")[row].as_py()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(get(at, "atom_index")), features], ["structure_id", "atom_index", "features"])


def _streamed(operator: LodeSphericalExpansion, long: bool, batches):
    radial, types, known = _radial(operator), len(operator.species), {}
    for run in runs(batches):
        flat, which = np.unique(run.cell.reshape(-1, 9), axis=0, return_inverse=True)
        for number, cell in enumerate(flat):
            mark = cell.tobytes()
            if mark not in known:
                known = {mark: operator.shared(radial, cell.reshape(3, 3))} | (known if len(known) < 64 else {})
            k, tables = known[mark]
            mine = np.flatnonzero(which.ravel() == number)
            ends = np.cumsum(run.sizes[mine]) * types * len(k)
            for piece in np.split(mine, np.flatnonzero(np.diff(ends // PIECE)) + 1):
                yield _expanded(operator, run, piece, k, tables, long)


def _expanded(operator: LodeSphericalExpansion, run: Run, piece: np.ndarray, k: np.ndarray, tables: list[np.ndarray], long: bool):
    import pyarrow as pa

    of = np.repeat(np.arange(len(piece)), run.sizes[piece])
    at = np.repeat(run.starts[piece] - np.cumsum(run.sizes[piece]) + run.sizes[piece], run.sizes[piece]) + np.arange(len(of))
    own = kinds(run.z[at], operator.species)
    values = operator.expanded(k, tables, of, own, run.at[at])
    if long:
        row, feature, value = cells(values)
        return batch([*KEYS, "feature", "value"], [run.sid[at][row], run.index[at][row], feature + (own[row] * values.shape[1]).astype(np.int32), value])
    placed = np.zeros((len(at), len(operator.species), values.shape[1]))
    placed[np.arange(len(at)), own] = values
    return pa.RecordBatch.from_arrays([pa.array(run.sid[at]), pa.array(run.index[at]), lists(placed.reshape(len(at), -1))], [*KEYS, "features"])


def _radial(operator: LodeSphericalExpansion):
    degree = 48 + int(20 * operator.k_cutoff * (operator.radial_radius or operator.cutoff) / sqrt(operator.max_radial + 1))
    return interpolated(operator.radial, operator.k_cutoff, degree)
