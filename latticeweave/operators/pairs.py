"""Operators over counts, edges and dense pairs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from math import log, pi, sqrt

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import erf
from ..plans.edges import framed, half_list, neighbor_edges
from ..plans.gathered import Run, batch, inverses, mapped, runs, volumes
from .base import Operator, require, type_index

#: Distances of a structure held at once.
PIECE = 1 << 21


@dataclass(frozen=True)
class AtomicComposition(Operator):
    """Counts of each species, per structure or (per_system=False) one-hot per atom."""

    species: tuple[int, ...]
    per_system: bool = True

    @property
    def level(self) -> str:
        return "structure" if self.per_system else "atom"

    def labels(self) -> list[str]:
        return [f"count Z={z}" for z in self.species]

    def plan(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        keys = ["structure_id"] if self.per_system else ["structure_id", "atom_index"]
        return atoms.groupBy(*keys, type_index(F.col("z"), self.species).alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))


@dataclass(frozen=True)
class NeighborList(Operator):
    """One row per edge: displacement and distance."""

    cutoff: float = 6.0
    full_neighbor_list: bool = True
    self_pairs: bool = False
    level = "pair"

    def __post_init__(self) -> None:
        require(self.cutoff > 0, "a cutoff is positive", "cutoff")

    def labels(self) -> list[str]:
        return ["dx", "dy", "dz", "distance"]

    def plan(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        edges = neighbor_edges(structures, atoms, self.cutoff, exact_self=self.self_pairs)
        edges = edges if self.full_neighbor_list else half_list(edges)
        return edges.select("structure_id", "i", "j", "sx", "sy", "sz", "dx", "dy", "dz", F.sqrt("d2").alias("distance"))

    def compute(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        return self.plan(structures, atoms).select("structure_id", "i", "j", "sx", "sy", "sz", F.array(*self.labels()).alias("features"))


@dataclass(frozen=True)
class SortedDistances(Operator):
    """The nearest distances of each centre, per neighbour species or over all; a species with any neighbour is padded
    with the cutoff, one without stays zero."""

    species: tuple[int, ...]
    cutoff: float = 6.0
    max_neighbors: int = 8
    separate_neighbor_types: bool = True

    def labels(self) -> list[str]:
        groups = [f"Z={z}" for z in self.species] if self.separate_neighbor_types else ["all"]
        return [f"{g} #{k}" for g in groups for k in range(self.max_neighbors)]

    def plan(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        edges = neighbor_edges(structures, atoms, self.cutoff)
        group = type_index(F.col("zj"), self.species) if self.separate_neighbor_types else F.lit(0)
        near = edges.select("structure_id", F.col("i").alias("atom_index"), group.alias("g"), F.sqrt("d2").alias("r"))
        order = Window.partitionBy("structure_id", "atom_index", "g").orderBy("r")
        top = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= self.max_neighbors)
        found = top.groupBy("structure_id", "atom_index", "g").agg(F.array_sort(F.collect_list("r")).alias("rs"))
        slots = F.transform(F.sequence(F.lit(0), F.lit(self.max_neighbors - 1)), lambda k: F.coalesce(F.get("rs", k), F.lit(float(self.cutoff))))
        return found.select("structure_id", "atom_index", "g", F.posexplode(slots).alias("k", "value")).select("structure_id", "atom_index", (F.col("g") * self.max_neighbors + F.col("k")).alias("feature"), "value")


def _spectra(batches):
    """Eigenvalues of one structure's symmetric matrix at a time, largest magnitude first; nan where it is not finite."""
    import numpy as np
    import pandas as pd

    for batch in batches:
        found = []
        for sid, cells in zip(batch["structure_id"], batch["m"], strict=True):
            n = max(c["i"] for c in cells) + 1
            m = np.zeros((n, n))
            for c in cells:
                m[c["i"], c["j"]] = c["value"]
            values = np.linalg.eigvalsh(m) if np.isfinite(m).all() else np.full(n, np.nan)
            values = values[np.argsort(-np.abs(values), kind="stable")]
            found.append(pd.DataFrame({"structure_id": sid, "feature": np.arange(n, dtype="int32"), "value": values}))
        if found:
            yield pd.concat(found)


def _eigenvalues(m: np.ndarray) -> np.ndarray:
    """Of symmetric matrices, largest magnitude first; nan where one is not finite."""
    finite = np.isfinite(m).all((1, 2))
    values = np.full(m.shape[:2], np.nan)
    found = np.linalg.eigvalsh(m[finite])
    values[finite] = np.take_along_axis(found, np.argsort(-np.abs(found), axis=1, kind="stable"), 1)
    return values


@dataclass(frozen=True)
class _PairMatrix(Operator):
    n_atoms_max: int | None = None
    permutation: str = "sorted_l2"
    exponent: float = 2.4
    level = "structure"

    def __post_init__(self) -> None:
        require(self.permutation in ("none", "sorted_l2", "eigenspectrum"), "permutation is none, sorted_l2 or eigenspectrum", "permutation")

    def labels(self) -> list[str]:
        require(self.n_atoms_max is not None, "labels need n_atoms_max", "n_atoms_max")
        if self.permutation == "eigenspectrum":
            return [f"eigenvalue {i}" for i in range(self.n_atoms_max)]
        return [f"M[{i},{j}]" for i in range(self.n_atoms_max) for j in range(self.n_atoms_max)]

    def sized(self, atoms: DataFrame) -> int:
        """Row length: the given one, or the largest structure's."""
        most = atoms.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        require(self.n_atoms_max is None or most <= self.n_atoms_max, "a structure has more than n_atoms_max atoms", "n_atoms_max")
        return self.n_atoms_max or most

    def elements(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        """structure_id, i, j, value."""
        raise NotImplementedError

    def dense(self, run: Run, which: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(structures, n, n) of the structures `which` of n atoms each, of one cell; at: (structures, n) their atoms."""
        raise NotImplementedError

    def streamed(self, n: int, batches):
        names = ["structure_id", "feature", "value"]
        for run in runs(batches):
            cells, cell = np.unique(run.cell.reshape(-1, 9), axis=0, return_inverse=True)
            group = run.sizes * len(cells) + cell.ravel()
            for value in np.unique(group):
                every = np.flatnonzero(group == value)
                size = int(run.sizes[every[0]])
                step = max(1, PIECE // (32 * size * size))
                for start in range(0, len(every), step):
                    which = every[start : start + step]
                    at = run.starts[which][:, None] + np.arange(size)
                    at = np.take_along_axis(at, np.argsort(run.index[at], axis=1, kind="stable"), 1)
                    m, place = self.dense(run, which, at), run.index[at]
                    sid = run.sid[run.starts[which]]
                    if self.permutation == "eigenspectrum":
                        values = _eigenvalues(m)
                        yield batch(names, [np.repeat(sid, size), np.tile(np.arange(size, dtype=np.int32), len(sid)), values.ravel()])
                        continue
                    if self.permutation == "sorted_l2":
                        # As in SQL: norms equal but for rounding keep the atoms' order, compared at twelve digits.
                        norms = np.array([float("%.12e" % v) for v in (m * m).sum(2).ravel()]).reshape(place.shape)
                        order = np.argsort(-norms, axis=1, kind="stable")
                        m = np.take_along_axis(np.take_along_axis(m, order[:, :, None], 1), order[:, None, :], 2)
                        place = np.broadcast_to(np.arange(size), place.shape)
                    feature = (place[:, :, None] * n + place[:, None, :]).astype(np.int32)
                    yield batch(names, [np.repeat(sid, size * size), feature.ravel(), m.ravel()])

    def plan(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        n = self.sized(atoms)
        known = structures.where("periodic") if self.periodic_only else structures
        return mapped(known, atoms, partial(self.streamed, n), "structure_id long, feature int, value double", lambda above: self.gathered(structures, above, n))

    def gathered(self, structures: DataFrame, atoms: DataFrame, n: int) -> DataFrame:
        """plan() of large structures."""
        cells = self.elements(structures, atoms)
        if self.permutation == "eigenspectrum":
            rows = cells.groupBy("structure_id").agg(F.collect_list(F.struct("i", "j", "value")).alias("m"))
            return rows.mapInPandas(_spectra, "structure_id long, feature int, value double")
        if self.permutation == "sorted_l2":
            norms = cells.groupBy("structure_id", "i").agg(F.sum(F.col("value") * F.col("value")).alias("n2"))
            # Norms equal but for rounding keep the atoms' order: compared at twelve digits.
            digits = F.format_string("%.12e", "n2").cast("double")
            order = norms.withColumn("rank", F.row_number().over(Window.partitionBy("structure_id").orderBy(digits.desc(), "i")) - 1).drop("n2")
            cells = cells.join(order, ["structure_id", "i"]).withColumnRenamed("rank", "a")
            cells = cells.join(order.withColumnsRenamed({"i": "j", "rank": "b"}), ["structure_id", "j"])
            cells = cells.select("structure_id", F.col("a").alias("i"), F.col("b").alias("j"), "value")
        return cells.select("structure_id", (F.col("i") * n + F.col("j")).cast("int").alias("feature"), "value")

    def pairs(self, atoms: DataFrame) -> DataFrame:
        left = atoms.select("structure_id", F.col("atom_index").alias("i"), F.col("z").alias("zi"), F.col("x").alias("xi"), F.col("y").alias("yi"), F.col("zc").alias("ci"))
        right = atoms.select("structure_id", F.col("atom_index").alias("j"), F.col("z").alias("zj"), F.col("x").alias("xj"), F.col("y").alias("yj"), F.col("zc").alias("cj"))
        return left.join(right, "structure_id")

    def compute(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        if self.n_atoms_max is None:
            from dataclasses import replace

            return replace(self, n_atoms_max=max(1, self.sized(atoms))).compute(structures, atoms)
        return super().compute(structures, atoms)

    def completed(self, m: np.ndarray, z: np.ndarray) -> np.ndarray:
        """With the nuclear charge's power on the diagonal."""
        own = np.arange(z.shape[1])
        m[:, own, own] = 0.5 * z**self.exponent
        return m

    def diagonal(self):
        return 0.5 * F.pow(F.col("zi").cast("double"), F.lit(self.exponent))


@dataclass(frozen=True)
class CoulombMatrix(_PairMatrix):
    """Half the nuclear charge's power on the diagonal, Zi Zj / r elsewhere (infinite where atoms coincide)."""

    def dense(self, run: Run, which: np.ndarray, at: np.ndarray) -> np.ndarray:
        z, p = run.z[at].astype(float), run.at[at]
        d = p[:, :, None] - p[:, None, :]
        r = np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2])
        return self.completed(np.where(r > 0, z[:, :, None] * z[:, None, :] / np.where(r > 0, r, 1.0), np.inf), z)

    def elements(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        dx, dy, dz = (F.col(a) - F.col(b) for a, b in (("xi", "xj"), ("yi", "yj"), ("ci", "cj")))
        r = F.sqrt(dx * dx + dy * dy + dz * dz)
        off = F.when(r > 0, F.col("zi") * F.col("zj") / F.nullif(r, F.lit(0.0))).otherwise(F.lit(float("inf")))
        return self.pairs(atoms).select("structure_id", "i", "j", F.when(F.col("i") == F.col("j"), self.diagonal()).otherwise(off).alias("value"))


@dataclass(frozen=True)
class SineMatrix(_PairMatrix):
    """Periodic: distances through the squared sine of fractional differences, mapped by the cell."""

    periodic_only = True

    def dense(self, run: Run, which: np.ndarray, at: np.ndarray) -> np.ndarray:
        z, p, cell = run.z[at].astype(float), run.at[at], run.cell[which[0]]
        inverse = inverses(cell[None], np.array([True]))[0]
        v = np.sin(pi * ((p[:, :, None] - p[:, None, :]) @ inverse)) ** 2 @ cell
        r = np.sqrt((v * v).sum(-1))
        return self.completed(np.where(r > 1e-14, z[:, :, None] * z[:, None, :] / np.maximum(r, 1e-14), 0.0), z)

    def elements(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        frames = framed(structures.where("periodic"), 1.0).select("structure_id", "cell", "inverse")
        d = [F.col(a) - F.col(b) for a, b in (("xi", "xj"), ("yi", "yj"), ("ci", "cj"))]
        rows = self.pairs(atoms).join(frames, "structure_id")
        for k in range(3):
            f = sum((d[r] * F.get("inverse", F.lit(3 * r + k)) for r in range(3)), F.lit(0.0))
            rows = rows.withColumn(f"s{k}", F.sin(pi * f) * F.sin(pi * f))
        v = [sum((F.col(f"s{k}") * F.get("cell", F.lit(3 * k + c)) for k in range(3)), F.lit(0.0)) for c in range(3)]
        r = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        off = F.when(r > 1e-14, F.col("zi") * F.col("zj") / F.greatest(r, F.lit(1e-14))).otherwise(0.0)
        return rows.select("structure_id", "i", "j", F.when(F.col("i") == F.col("j"), self.diagonal()).otherwise(off).alias("value"))


@dataclass(frozen=True)
class EwaldSumMatrix(_PairMatrix):
    """Periodic: screened pair sums in real and reciprocal space, less self and background terms.

    Unless given, the screening and both cutoffs follow each structure's size and volume, so every structure has its
    own radius. The reciprocal sum runs over half of the vectors, as +G and -G give the same cosine. exponent is not used.
    """

    accuracy: float = 1e-5
    w: float = 1.0
    r_cut: float | None = None
    g_cut: float | None = None
    a: float | None = None
    periodic_only = True

    def __post_init__(self) -> None:
        super().__post_init__()
        require(0 < self.accuracy < 1, "accuracy lies between 0 and 1", "accuracy")
        require(self.w > 0, "w is positive", "w")
        require((self.r_cut is None) == (self.g_cut is None), "r_cut and g_cut are given together", "g_cut")

    def screened(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        """Adds volume, alpha, rc and gc to the periodic structures that have atoms."""
        sizes = atoms.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"))
        m = [F.get("cell", F.lit(k)) for k in range(9)]
        volume = F.abs(m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6]))
        found = structures.where("periodic").select("structure_id", "cell", "periodic", volume.alias("volume")).join(sizes, "structure_id")
        given = self.a is not None and self.a > 0
        alpha = F.lit(float(self.a)) if given else sqrt(pi) * F.pow(F.col("n") * float(self.w) / (F.col("volume") * F.col("volume")), F.lit(1 / 6))
        reach = sqrt(-log(self.accuracy))
        found = found.withColumn("alpha", alpha)
        rc = reach / F.col("alpha") if self.r_cut is None else F.lit(float(self.r_cut))
        gc = 2 * reach * F.col("alpha") if self.g_cut is None else F.lit(float(self.g_cut))
        return found.withColumns({"rc": rc, "gc": gc})

    def dense(self, run: Run, which: np.ndarray, at: np.ndarray) -> np.ndarray:
        cell = run.cell[which[0]]
        volume, reach = float(volumes(cell[None])[0]), sqrt(-log(self.accuracy))
        alpha = float(self.a) if self.a is not None and self.a > 0 else sqrt(pi) * (at.shape[1] * self.w / (volume * volume)) ** (1 / 6)
        rc = reach / alpha if self.r_cut is None else float(self.r_cut)
        gc = 2 * reach * alpha if self.g_cut is None else float(self.g_cut)
        return ewald_stack(cell, run.z[at].astype(float), run.at[at], volume, alpha, rc, gc)

    def elements(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        """A structure's atoms meet in one row, as its matrix does later; sums over images and waves are made there."""
        gathered = atoms.groupBy("structure_id").agg(F.collect_list(F.struct("atom_index", "z", "x", "y", "zc")).alias("atoms"))
        known = self.screened(structures, atoms).select("structure_id", "cell", "volume", "alpha", "rc", "gc")
        return gathered.join(known, "structure_id").mapInArrow(_ewald_rows, "structure_id long, i int, j int, value double")


def ewald_sums(cell: np.ndarray, z: np.ndarray, at: np.ndarray, volume: float, alpha: float, rc: float, gc: float) -> np.ndarray:
    """(atoms, atoms): images in pieces of PIECE distances, waves as products of cosines and sines."""
    inverse, charges, total = np.linalg.inv(cell), np.outer(z, z), np.full((len(z), len(z)), -pi / (volume * alpha**2))
    apart = (at[None, :] - at[:, None]) @ inverse
    apart -= np.round(apart)
    tops = np.floor(rc * np.sqrt((inverse**2).sum(0)) + 0.5).astype(int)
    shifts = np.stack(np.meshgrid(*[np.arange(-t, t + 1) for t in tops], indexing="ij"), -1).reshape(-1, 3)
    step = max(1, PIECE // max(1, charges.size))
    for start in range(0, len(shifts), step):
        d = (apart + shifts[start : start + step, None, None]) @ cell
        square = (d * d).sum(-1)
        near = (square > 1e-16) & (square <= rc * rc)
        r = np.sqrt(square[near])
        values = np.zeros(square.shape)
        values[near] = (1 - erf(alpha * r)) / r
        total += values.sum(0)
    tops = np.floor(gc * np.sqrt((cell**2).sum(1)) / (2 * pi)).astype(int)
    n = np.stack(np.meshgrid(*[np.arange(-t, t + 1) for t in tops], indexing="ij"), -1).reshape(-1, 3)
    # The second half of all vectors: one of each opposite pair.
    g = 2 * pi * n[len(n) // 2 + 1 :] @ inverse.T
    q = (g * g).sum(1)
    g, q = g[q <= gc * gc], q[q <= gc * gc]
    factor, phase = 8 * pi / volume * np.exp(-q / (4 * alpha**2)) / q, at @ g.T
    c, s = np.cos(phase), np.sin(phase)
    total += (c * factor) @ c.T + (s * factor) @ s.T
    own = np.eye(len(z))
    return charges * total * (1 - own / 2) - own * charges * alpha / sqrt(pi)


def ewald_stack(cell: np.ndarray, z: np.ndarray, at: np.ndarray, volume: float, alpha: float, rc: float, gc: float) -> np.ndarray:
    """ewald_sums of structures (structures, atoms) of one cell and size: each pair once, which both its places get."""
    inverse, n = np.linalg.inv(cell), z.shape[1]
    i, j = np.triu_indices(n)
    apart = ((at[:, j] - at[:, i]) @ inverse).reshape(-1, 3)
    apart -= np.round(apart)
    tops = np.floor(rc * np.sqrt((inverse**2).sum(0)) + 0.5).astype(int)
    shifts = np.stack(np.meshgrid(*[np.arange(-t, t + 1) for t in tops], indexing="ij"), -1).reshape(-1, 3) @ cell
    # Pairs are at most half the cell's diagonals apart, so farther shifts reach no pair.
    far = np.sqrt(((np.array([[1, 1, 1], [1, 1, -1], [1, -1, 1], [-1, 1, 1]]) @ cell) ** 2).sum(1)).max() / 2
    shifts = shifts[np.sqrt((shifts * shifts).sum(1)) <= rc + far * (1 + 1e-9)]
    near, d = np.zeros(len(apart)), apart @ cell
    step = max(1, PIECE // (16 * max(1, len(shifts))))
    for start in range(0, len(d), step):
        part = d[start : start + step]
        square = sum((part[:, c, None] + shifts[:, c]) ** 2 for c in range(3))
        row, column = np.nonzero((square > 1e-16) & (square <= rc * rc))
        r = np.sqrt(square[row, column])
        near[start : start + step] = np.bincount(row, (1 - erf(alpha * r)) / r, len(part))
    total = np.full((len(z), n, n), -pi / (volume * alpha**2))
    total[:, i, j] += near.reshape(len(z), -1)
    total[:, j, i] = total[:, i, j]
    tops = np.floor(gc * np.sqrt((cell**2).sum(1)) / (2 * pi)).astype(int)
    m = np.stack(np.meshgrid(*[np.arange(-t, t + 1) for t in tops], indexing="ij"), -1).reshape(-1, 3)
    g = 2 * pi * m[len(m) // 2 + 1 :] @ inverse.T
    q = (g * g).sum(1)
    g, q = g[q <= gc * gc], q[q <= gc * gc]
    factor = 8 * pi / volume * np.exp(-q / (4 * alpha**2)) / q
    step = max(1, PIECE // (8 * n * max(1, len(g))))
    for start in range(0, len(z), step):
        phase = at[start : start + step] @ g.T
        c, s = np.cos(phase), np.sin(phase)
        total[start : start + step] += (c * factor) @ c.transpose(0, 2, 1) + (s * factor) @ s.transpose(0, 2, 1)
    charges, own = z[:, :, None] * z[:, None, :], np.eye(n)
    return charges * total * (1 - own / 2) - own * charges * alpha / sqrt(pi)


def _ewald_rows(batches):
    import pyarrow as pa

    for batch in batches:
        columns = {c: batch.column(c).to_numpy() for c in ("structure_id", "volume", "alpha", "rc", "gc")}
        for row in range(batch.num_rows):
            atoms = batch.column("atoms")[row].values
            get = lambda name: atoms.field(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            cell = np.array(batch.column("cell")[row].as_py()).reshape(3, 3)
            m = ewald_sums(cell, get("z").astype(float), np.stack([get("x"), get("y"), get("zc")], 1), *[columns[c][row] for c in ("volume", "alpha", "rc", "gc")])
            index = get("atom_index")
            ids = np.full(m.size, columns["structure_id"][row])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids, np.repeat(index, len(index)), np.tile(index, len(index)), m.ravel())], ["structure_id", "i", "j", "value"])
