"""Operators that expand each atom's surroundings in radial and angular functions.

Structures stream to Python whole, where their edges are found and expanded, many centres at once. Those of too many
atoms for that have their edges gathered per centre in the JVM (a centre's neighbours within a cutoff are bounded by the
density): no group of rows is larger than one centre's surroundings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import factorial, gamma, log, pi, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import smooth
from ..plans.edges import neighbor_edges
from ..plans.gathered import Run, batch, edges_of, kinds, lists, mapped, runs
from .base import Operator, require, type_index

#: Centres of gathered edges that are expanded at once, and edges of streamed structures: they bound a task's memory.
BLOCK, EDGES = 64, 2048
KEYS = ("structure_id", "atom_index")


@dataclass
class Edges:
    """Edges of a block of centres: arrays over edges, starts per centre, t: neighbour types, ti: centre types."""

    d: np.ndarray
    r: np.ndarray
    z: np.ndarray
    t: np.ndarray
    starts: np.ndarray
    zi: np.ndarray
    ti: np.ndarray
    own: np.ndarray
    j: np.ndarray | None = None

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sum over each centre's edges; every centre has one."""
        return np.add.reduceat(values, self.starts, axis=0)

    def by_type(self, values: np.ndarray, types: int) -> np.ndarray:
        """(centres, types, ...)."""
        key = self.centres() * types + self.t
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.diff(key[order], prepend=-1))
        out = np.zeros((len(self.zi) * types, *values.shape[1:]), values.dtype)
        out[key[order][heads]] = np.add.reduceat(values[order], heads, axis=0)
        return out.reshape(len(self.zi), types, *values.shape[1:])

    def centres(self) -> np.ndarray:
        """Index of each edge's centre."""
        return np.repeat(np.arange(len(self.zi)), np.diff(np.append(self.starts, len(self.r))))


def inverse_root(m: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(m)
    require(bool((values > 0).all()), "the radial basis is not independent", "basis")
    return (vectors / np.sqrt(values)) @ vectors.T


def harmonics(d: np.ndarray, top: int) -> np.ndarray:
    """Orthonormal real spherical harmonics of directions, (edges, (top+1)^2), m from -l to l; the pole for zero."""
    r = np.sqrt((d * d).sum(1))
    u = d / np.where(r > 0, r, 1.0)[:, None]
    x, y, z = u[:, 0], u[:, 1], np.where(r > 0, u[:, 2], 1.0)
    out = np.empty((len(d), (top + 1) ** 2))
    turn = np.ones(len(d), complex)
    diagonal = 1.0
    for m in range(top + 1):
        if m:
            turn, diagonal = turn * (x + 1j * y), diagonal * (2 * m - 1)
        before, q = np.zeros(len(d)), np.full(len(d), diagonal)
        for k in range(m, top + 1):
            if k > m:
                before, q = q, ((2 * k - 1) * z * q - (k + m - 1) * before) / (k - m)
            scale = sqrt((2 * k + 1) / (4 * pi) * factorial(k - m) / factorial(k + m) * (2 if m else 1))
            out[:, k * k + k + m] = scale * q * turn.real
            if m:
                out[:, k * k + k - m] = scale * q * turn.imag
    return out


def scaled_kummer(a: float, b: float, z: np.ndarray) -> np.ndarray:
    """exp(-z) 1F1(a; b; z) for z >= 0: the power series, whose terms are positive, or the asymptotic one from 60 on."""
    out = np.empty_like(z)
    near = z < 60
    x = z[near]
    term, total, k = np.ones_like(x), np.ones_like(x), 0
    while x.size and (term > 1e-17 * total).any():
        term = term * (a + k) / (b + k) * x / (k + 1)
        total, k = total + term, k + 1
    out[near] = total * np.exp(-x)
    x = z[~near]
    term, total = np.ones_like(x), np.ones_like(x)
    for k in range(25):
        term = term * (b - a + k) * (1 - a + k) / (k + 1) / np.where(x > 0, x, 1.0)
        total = total + term
    out[~near] = gamma(b) / gamma(a) * x ** (a - b) * total
    return out


@dataclass(frozen=True)
class _Local(Operator):
    """Subclasses give reach, keeps_self, width and kernel()."""

    @property
    def reach(self) -> float:
        raise NotImplementedError

    keeps_self = False
    typed = True
    #: whether edges know their neighbour's index
    named = False

    def kernel(self) -> Callable[[Edges], np.ndarray]:
        """Built once per task from the configuration; gives (centres, width)."""
        raise NotImplementedError

    def gathered(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        edges = neighbor_edges(structures, atoms, self.reach, exact_self=self.keeps_self)
        kind = lambda c: type_index(F.col(c), self.species) if self.typed else F.lit(0)
        edges = edges.withColumns({"ti": kind("zi"), "t": kind("zj")})
        own = (F.col("i") == F.col("j")) & (F.col("sx") == 0) & (F.col("sy") == 0) & (F.col("sz") == 0)
        near = F.struct("zj", "t", "dx", "dy", "dz", F.sqrt("d2").alias("r"), own.alias("own"), *(["j"] if self.named else []))
        return edges.groupBy("structure_id", F.col("i").alias("atom_index"), F.col("zi").alias("z"), "ti").agg(F.collect_list(near).alias("near"))

    def expanded(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        """structure_id, atom_index, features of the atoms that have an edge, from gathered edges."""
        return self.gathered(structures, atoms).mapInArrow(_mapper(self), "structure_id long, atom_index int, features array<double>")

    def plan(self, structures: DataFrame, atoms: DataFrame, least: float = 0.0) -> DataFrame:
        """least: values up to it, with either sign, are left out like zeros."""
        rest = lambda above: self.expanded(structures, above).select(*KEYS, F.posexplode("features").alias("feature", "value")).where(F.abs("value") > least)
        run = _streamed_blocks(self, least) if isinstance(self, _Expansion) else _streamed(self, _long(least))
        return mapped(structures, atoms, run, "structure_id long, atom_index int, feature int, value double", rest)

    def compute(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        self.check(structures)
        none = F.array_repeat(F.lit(0.0), self.width)
        rest = lambda above: above.select(*KEYS).join(self.expanded(structures, above), list(KEYS), "left").select(*KEYS, F.coalesce("features", none).alias("features"))
        return mapped(structures, atoms, _streamed(self, _rows), "structure_id long, atom_index int, features array<double>", rest)

    def parts(self, batches, exact_self: bool | None = None) -> Iterator[tuple[Run, np.ndarray, Edges]]:
        """Whole structures, and a piece of their atoms that have an edge with these edges; one piece after the other."""
        for run in runs(batches):
            for part, pairs in edges_of(run, self.reach, exact_self=self.keeps_self if exact_self is None else exact_self):
                near = np.concatenate([pairs.i, pairs.j])
                t = np.zeros(len(part.z), int)
                if self.typed:
                    t[near] = kinds(part.z[near], self.species)
                heads = np.flatnonzero(np.diff(pairs.i, prepend=-1))
                ends = np.append(heads[1:], len(pairs.i))
                first = 0
                while first < len(heads):
                    last = max(first + 1, int(np.searchsorted(ends, heads[first] + EDGES, "right")))
                    own, of = pairs.i[heads[first:last]], slice(heads[first], ends[last - 1])
                    j = pairs.j[of]
                    yield part, own, Edges(pairs.d[of], np.sqrt(pairs.d2[of]), part.z[j], t[j], heads[first:last] - heads[first], part.z[own], t[own], pairs.own[of], j)
                    first = last
                if not len(heads):
                    yield part, np.zeros(0, int), None


def blocks(batches, named: bool = False):
    """(rows, edges) of BLOCK centres at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(start, BLOCK)
            lists = rows.column("near")
            at, offsets = lists.flatten(), lists.offsets.to_numpy()
            get = lambda name: at.field(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            d = np.stack([get("dx"), get("dy"), get("dz")], 1)
            yield rows, Edges(d, get("r"), get("zj"), get("t"), offsets[:-1] - offsets[0], rows.column("z").to_numpy(), rows.column("ti").to_numpy(), get("own"), get("j") if named else None)


def _mapper(operator: _Local):
    def run(batches):
        import pyarrow as pa

        kernel = operator.kernel()
        for rows, edges in blocks(batches):
            values = kernel(edges)
            ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
            features = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel()))
            yield pa.RecordBatch.from_arrays([rows.column("structure_id"), rows.column("atom_index"), features], ["structure_id", "atom_index", "features"])

    return run


def _streamed(operator: _Local, shape: Callable):
    def run(batches):
        kernel = operator.kernel()
        yield from shape(operator, ((part, own, None if e is None else kernel(e)) for part, own, e in operator.parts(batches)))

    return run


def _streamed_blocks(operator: _Expansion, least: float):
    """Long rows of blocks that are never placed among those of the other species."""

    def run(batches):
        block = operator.block()
        for part, own, e in operator.parts(batches):
            if e is not None:
                values = block(e)
                row, feature, value = cells(values, least)
                at = own[row]
                yield batch([*KEYS, "feature", "value"], [part.sid[at], part.index[at], feature + (e.ti[row] * values.shape[1]).astype(np.int32), value])

    return run


def cells(values: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of what is beyond least, or isn't a number; searched the way the matrix lies in memory."""
    turned = values.flags.f_contiguous and not values.flags.c_contiguous
    flat = (values.T if turned else values).ravel()
    found = np.flatnonzero(~(np.abs(flat) <= least) if least else flat)
    row, feature = np.divmod(found, values.shape[1])
    if turned:
        feature, row = np.divmod(found, values.shape[0])
    return row, feature.astype(np.int32), flat[found]


def _long(least: float):
    def shape(operator: _Local, kernels):
        for part, own, values in kernels:
            if values is not None:
                row, feature, value = cells(values, least)
                at = own[row]
                yield batch([*KEYS, "feature", "value"], [part.sid[at], part.index[at], feature, value])

    return shape


def _rows(operator: _Local, found):
    """Every atom's features, those without an edge zeros, which follow the part they belong to."""
    width, part, lone = operator.width, None, None

    def zeros():
        at = np.flatnonzero(lone)
        for start in range(0, len(at), EDGES):
            rest = at[start : start + EDGES]
            yield rows(part, rest, np.zeros((len(rest), width)))

    def rows(part, at, values):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(part.sid[at]), pa.array(part.index[at]), lists(values)], [*KEYS, "features"])

    for here, own, values in found:
        if here is not part:
            if part is not None:
                yield from zeros()
            part, lone = here, np.ones(len(here.z), bool)
        if values is not None:
            lone[own] = False
            yield rows(part, own, values)
    if part is not None:
        yield from zeros()


@dataclass(frozen=True)
class _Expansion(_Local):
    """Gaussian densities in orthonormal Gaussian-type radial functions and real harmonics, the centre included."""

    species: tuple[int, ...]
    cutoff: float = 6.0
    density_width: float = 0.3
    max_radial: int = 6
    max_angular: int = 4
    keeps_self = True

    def __post_init__(self) -> None:
        require(self.cutoff > 0 and self.density_width > 0, "a cutoff and a width are positive", "cutoff")
        require(self.max_radial >= 0 and self.max_angular >= 0, "sizes are not negative", "max_radial")

    @property
    def reach(self) -> float:
        return self.cutoff

    @property
    def angular(self) -> int:
        return self.max_angular

    def basis(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """From distances and displacements to (edges, (angular+1)^2, radial)."""
        size, top = self.max_radial + 1, self.angular
        n = np.arange(size)
        widths = self.cutoff * np.maximum(np.sqrt(n), 1.0) / size
        own = 1 / (2 * widths**2)
        half = np.array([gamma(k + 1.5) for k in n])
        norms = np.sqrt(2 / (widths ** (2 * n + 3) * half))
        power = (3.0 + n[:, None] + n) / 2
        overlap = (own[:, None] + own) ** -power * np.vectorize(gamma)(power) * norms[:, None] * norms / 2
        mixing = norms[:, None] * inverse_root(overlap)
        c = 1 / (2 * self.density_width**2)
        front = (pi / self.density_width**2) ** 0.75

        def radial(r: np.ndarray, k: int) -> np.ndarray:
            raw = np.empty((len(r), size))
            for m in range(size):
                a, b = (m + k + 3) / 2, k + 1.5
                z = (c * r) ** 2 / (c + own[m])
                raw[:, m] = gamma(a) / gamma(b) * scaled_kummer(a, b, z) * (c + own[m]) ** -a * front * np.exp(z - c * r * r) * (c * r) ** k
            return raw @ mixing

        width = min(0.5, self.cutoff)
        every = smooth(lambda r: np.concatenate([radial(r, k) for k in range(top + 1)], axis=1), self.cutoff)

        def basis(r: np.ndarray, d: np.ndarray) -> np.ndarray:
            fade = np.where(r <= self.cutoff - width, 1.0, 0.5 * (1 + np.cos(pi * (r - self.cutoff + width) / width))) * (r < self.cutoff)
            y, g = harmonics(d, top) * fade[:, None], every(np.minimum(r, self.cutoff))
            return np.concatenate([y[:, k * k : (k + 1) ** 2, None] * g[:, None, k * size : (k + 1) * size] for k in range(top + 1)], axis=1)

        return basis

    def coefficients(self) -> Callable[[Edges], np.ndarray]:
        """(centres, species, harmonics, radial)."""
        basis, types = self.basis(), len(self.species)
        return lambda e: e.by_type(basis(e.r, e.d), types)

    def block(self) -> Callable[[Edges], np.ndarray]:
        """As kernel(), of a centre's own species alone."""
        raise NotImplementedError

    def kernel(self) -> Callable[[Edges], np.ndarray]:
        block = self.block()
        return lambda e: self.placed(e, block(e))

    def placed(self, e: Edges, block: np.ndarray) -> np.ndarray:
        """Each centre's block at its species."""
        out = np.zeros((len(block), len(self.species), block[0].size))
        out[np.arange(len(block)), e.ti] = block.reshape(len(block), -1)
        return out.reshape(len(block), -1)

    def channels(self) -> list[str]:
        return [f"l={k} m={m} n={n}" for k in range(self.angular + 1) for m in range(-k, k + 1) for n in range(self.max_radial + 1)]


@dataclass(frozen=True)
class SphericalExpansion(_Expansion):
    """Coefficients by centre species, neighbour species, l, m, n."""

    def labels(self) -> list[str]:
        return [f"Z={a},{b} {c}" for a in self.species for b in self.species for c in self.channels()]

    def block(self) -> Callable[[Edges], np.ndarray]:
        find = self.coefficients()
        return lambda e: find(e).reshape(len(e.zi), -1)


@dataclass(frozen=True)
class SoapRadialSpectrum(_Expansion):
    """The part without direction; max_angular has no effect."""

    @property
    def angular(self) -> int:
        return 0

    def labels(self) -> list[str]:
        return [f"Z={a},{b} n={n}" for a in self.species for b in self.species for n in range(self.max_radial + 1)]

    def block(self) -> Callable[[Edges], np.ndarray]:
        find = self.coefficients()
        return lambda e: find(e).reshape(len(e.zi), -1)


@dataclass(frozen=True)
class SoapPowerSpectrum(_Expansion):
    """Products of coefficients summed over m, by centre species, unordered neighbour species, l, n, n'."""

    def labels(self) -> list[str]:
        s, size = self.species, range(self.max_radial + 1)
        return [f"Z={z} of {s[a]},{s[b]} l={k} n={m},{n}" for z in s for a in range(len(s)) for b in range(a, len(s)) for k in range(self.max_angular + 1) for m in size for n in size]

    def block(self) -> Callable[[Edges], np.ndarray]:
        find, types = self.coefficients(), len(self.species)

        def power(e: Edges) -> np.ndarray:
            # Centres come last, where products run over them without a gap.
            c, parts = np.ascontiguousarray(np.moveaxis(find(e), 0, -1)), []
            for a in range(types):
                for b in range(a, types):
                    for k in range(self.max_angular + 1):
                        of = slice(k * k, (k + 1) ** 2)
                        scale = (-1) ** k / sqrt(2 * k + 1) * (1.0 if a == b else sqrt(2))
                        parts.append(scale * np.einsum("mix,mjx->ijx", c[a, of], c[b, of]).reshape(-1, c.shape[-1]))
            return np.concatenate(parts).T

        return power


@dataclass(frozen=True)
class SphericalExpansionByPair(_Expansion):
    """One row per edge, exact self edges included, with the pair's own l, m, n; edges at the cutoff are left out."""

    level = "pair"

    def labels(self) -> list[str]:
        return self.channels()

    def compute(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        rest = lambda above: self.gathered_pairs(structures, above)
        return mapped(structures, atoms, _streamed_pairs(self, False), f"{PAIR_KEYS}, features array<double>", rest)

    def gathered_pairs(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        keys = ["structure_id", "i", "j", "sx", "sy", "sz"]
        declared = (type_index(F.col("zi"), self.species) >= 0) & (type_index(F.col("zj"), self.species) >= 0)
        edges = neighbor_edges(structures, atoms, self.cutoff, boundary=False, exact_self=True).where(declared)
        made = self.basis

        def run(batches):
            import pyarrow as pa

            basis = made()
            for batch in batches:
                for start in range(0, batch.num_rows, 16 * BLOCK):
                    rows = batch.slice(start, 16 * BLOCK)
                    d = np.stack([rows.column(c).to_numpy() for c in ("dx", "dy", "dz")], 1)
                    values = basis(np.sqrt((d * d).sum(1)), d).reshape(len(d), -1)
                    ends = np.arange(len(d) + 1, dtype=np.int32) * values.shape[1]
                    features = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))
                    yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in keys], features], [*keys, "features"])

        return edges.select(*keys, "dx", "dy", "dz").mapInArrow(run, f"{PAIR_KEYS}, features array<double>")

    def plan(self, structures: DataFrame, atoms: DataFrame, least: float = 0.0) -> DataFrame:
        rest = lambda above: self.gathered_pairs(structures, above).select("structure_id", "i", "j", "sx", "sy", "sz", F.posexplode("features").alias("feature", "value")).where(F.abs("value") > least)
        return mapped(structures, atoms, _streamed_pairs(self, True, least), f"{PAIR_KEYS}, feature int, value double", rest)


PAIR_KEYS = "structure_id long, i int, j int, sx int, sy int, sz int"


def _streamed_pairs(operator: SphericalExpansionByPair, long: bool, least: float = 0.0):
    def run(batches):
        import pyarrow as pa

        basis, names = operator.basis(), ["structure_id", "i", "j", "sx", "sy", "sz"]
        for whole in runs(batches):
            for part, pairs in edges_of(whole, operator.cutoff, boundary=False, exact_self=True):
                kinds(part.z, operator.species)
                for start in range(0, len(pairs.i), EDGES):
                    of = slice(start, start + EDGES)
                    keys = [part.sid[pairs.i[of]], part.index[pairs.i[of]], part.index[pairs.j[of]], *pairs.s[of].astype(np.int32).T]
                    values = basis(np.sqrt(pairs.d2[of]), pairs.d[of]).reshape(len(keys[0]), -1)
                    if long:
                        row, feature, value = cells(values, least)
                        yield batch([*names, "feature", "value"], [*[k[row] for k in keys], feature, value])
                    else:
                        yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(k)) for k in keys], lists(values)], [*names, "features"])

    return run


@dataclass(frozen=True)
class SO3(_Local):
    """Power spectrum of Gaussian densities in orthonormal polynomials, by quadrature at Chebyshev nodes.

    Order: n, n' <= n, l. Neighbours weigh their atomic number; with weight_on those of another element count negative."""

    nmax: int = 3
    lmax: int = 3
    rcut: float = 3.5
    alpha: float = 2.0
    weight_on: bool = False
    typed = False

    def __post_init__(self) -> None:
        require(self.nmax > 0 and self.lmax >= 0 and self.rcut > 0 and self.alpha > 0, "sizes, the cutoff and alpha are positive", "nmax")

    @property
    def reach(self) -> float:
        return self.rcut

    def labels(self) -> list[str]:
        return [f"n={a},{b} l={k}" for a in range(self.nmax) for b in range(a + 1) for k in range(self.lmax + 1)]

    def kernel(self) -> Callable[[Edges], np.ndarray]:
        count = (self.nmax + self.lmax + 1) * 10
        x = np.cos((2 * np.arange(1, count + 1) - 1) * pi / (2 * count))
        q = self.rcut * (x + 1) / 2
        k = np.arange(1, self.nmax + 1)
        edge = (2.0 * k + 5) * (2 * k + 6) * (2 * k + 7)
        pair = k[:, None] + k
        root = inverse_root(np.sqrt(edge[:, None] * edge) / ((5.0 + pair) * (6 + pair) * (7 + pair)))
        phi = (self.rcut - q) ** (k[:, None] + 2.0) / np.sqrt(2 * self.rcut ** (2.0 * k + 7) / edge)[:, None]
        radial = root @ phi * (q * q * np.exp(-self.alpha * q * q) * np.sqrt(1 - x * x) * pi / count * self.rcut / 2)
        scale = [sqrt(2 * sqrt(2) * pi / sqrt(2 * m + 1)) for m in range(self.lmax + 1)]
        damped = lambda r, m: modified_bessel(2 * self.alpha * r[:, None] * q, m) @ radial.T * (np.exp(-self.alpha * r * r) * scale[m])[:, None]
        every = smooth(lambda r: np.concatenate([damped(r, m) for m in range(self.lmax + 1)], axis=1), self.rcut)

        def power(e: Edges) -> np.ndarray:
            fade = np.where((e.r > 0) & (e.r < self.rcut), 0.5 * (np.cos(pi * e.r / self.rcut) + 1), 0.0)
            sign = np.where(self.weight_on & (e.z != e.zi[e.centres()]), -1.0, 1.0)
            y, out = harmonics(e.d, self.lmax), []
            found = every(np.minimum(e.r, self.rcut)) * (sign * e.z * 4 * pi * fade)[:, None]
            for m in range(self.lmax + 1):
                g = found[:, m * self.nmax : (m + 1) * self.nmax]
                c = e.total(g[:, :, None] * y[:, None, m * m : (m + 1) ** 2])
                out.append(np.einsum("xam,xbm->xab", c, c))
            a, b = np.tril_indices(self.nmax)
            return np.stack(out, -1)[:, a, b].reshape(len(e.zi), -1)

        return power


def modified_bessel(x: np.ndarray, k: int) -> np.ndarray:
    """Modified spherical Bessel function of the first kind: x^k / (2k+1)!! 1F1(k+1; 2k+2; 2x) exp(-x)."""
    front = 1.0
    for m in range(1, k + 1):
        front /= 2 * m + 1
    return front * x**k * np.exp(x) * scaled_kummer(k + 1.0, 2 * k + 2.0, (2 * x).ravel()).reshape(x.shape)


@dataclass(frozen=True)
class MTP(_Local):
    """Moment tensors. Without a model: traces of even ranks by channel, then dot products of channel pairs by rank.

    A channel is (neighbour species, radial function, Chebyshev order). A trace of unit vectors' even tensor is its
    rank 0; dot products run over distinct components, weighted by how often each occurs.

    model: a path or a text of named assignments; distances and sizes are then the model's, and features a constant one
    and the model's scalars."""

    species: tuple[int, ...]
    min_dist: float = 0.0
    max_dist: float = 5.0
    radial_basis_size: int = 4
    radial_funcs_count: int = 1
    max_rank: int = 2
    model: str | None = None

    def __post_init__(self) -> None:
        require(0 <= self.min_dist < self.max_dist, "distances have a range", "max_dist")
        require(0 <= self.max_rank <= 5 and self.radial_basis_size > 0 and self.radial_funcs_count > 0, "max_rank is 0 to 5, sizes are positive", "max_rank")
        if self.model is not None:
            from .moments import parse_moments

            text = self.model
            if "\n" not in text:
                with open(text) as file:
                    text = file.read()
            object.__setattr__(self, "parsed", parse_moments(text))
            require(self.parsed.types == len(self.species), "the model has another number of species", "species")

    @property
    def keeps_self(self) -> bool:
        return self.model is not None

    @property
    def reach(self) -> float:
        return self.parsed.max_dist if self.model is not None else self.max_dist

    def labels(self) -> list[str]:
        if self.model is not None:
            return ["constant", *[f"moment {k}" for k in self.parsed.mapping]]
        own = [f"Z={z} f={f} n={n}" for z in self.species for f in range(self.radial_funcs_count) for n in range(self.radial_basis_size)]
        traces = [f"trace {c} rank={k}" for c in own for k in range(0, self.max_rank + 1, 2)]
        return traces + [f"{own[a]} . {own[b]} rank={k}" for k in range(self.max_rank + 1) for a in range(len(own)) for b in range(a, len(own))]

    def kernel(self) -> Callable[[Edges], np.ndarray]:
        if self.model is not None:
            from .moments import moment_features

            return moment_features(self.parsed)
        types = len(self.species)

        def features(e: Edges) -> np.ndarray:
            x = (e.r - self.min_dist) / (self.max_dist - self.min_dist)
            inside = (e.r > 0) & (e.r >= self.min_dist) & (e.r <= self.max_dist)
            fade = np.where(inside, (0.5 * (1 + np.cos(pi * x))) ** 2, 0.0)
            cheb = np.polynomial.chebyshev.chebvander(2 * x - 1, max(1, self.radial_basis_size - 1))[:, : self.radial_basis_size]
            radial = np.concatenate([(fade * x**f)[:, None] * cheb for f in range(self.radial_funcs_count)], axis=1)
            u = e.d / np.where(e.r > 0, e.r, 1.0)[:, None]
            traces, dots = None, []
            for k in range(self.max_rank + 1):
                powers = [(a, b, k - a - b) for a in range(k + 1) for b in range(k - a + 1)]
                often = np.array([factorial(k) / (factorial(a) * factorial(b) * factorial(c)) for a, b, c in powers])
                monomials = np.stack([u[:, 0] ** a * u[:, 1] ** b * u[:, 2] ** c for a, b, c in powers], 1)
                moments = e.by_type(radial[:, :, None] * monomials[:, None, :], types)
                moments = moments.reshape(len(moments), -1, len(powers))
                a, b = np.triu_indices(moments.shape[1])
                dots.append((np.einsum("xap,xbp,p->xab", moments, moments, often))[:, a, b])
                if k == 0:
                    traces = np.repeat(moments[:, :, 0], self.max_rank // 2 + 1, axis=1)
            return np.concatenate([traces, *dots], axis=1)

        return features


@dataclass(frozen=True)
class SOAP(_Local):
    """Smooth overlap power spectra with orthonormal radial functions, the centre included.

    rbf: gto (Gaussian-type) or polynomial (powers of the distance to the cutoff, from the third). weighting of
    neighbours: function poly, pow or exp with r0, c, and m or d as they need; w0 for the centre; species_weighting, a
    weight per species. Without r_cut it follows from the function and its threshold, else it is 6.

    average: off (per atom), inner (of coefficients) or outer (of spectra), the latter two per structure. compression:
    off, mu2 (one density), mu1nu1 (each species with all) or crossover (each species with itself)."""

    species: tuple[int, ...]
    r_cut: float | None = None
    n_max: int = 8
    l_max: int = 6
    sigma: float = 1.0
    average: str = "inner"
    compression: str = "off"
    rbf: str = "gto"
    weighting: dict | None = None
    species_weighting: tuple[float, ...] | None = None
    keeps_self = True

    def __post_init__(self) -> None:
        require(self.average in ("off", "inner", "outer"), "average is off, inner or outer", "average")
        require(self.compression in ("off", "mu2", "mu1nu1", "crossover"), "unknown compression", "compression")
        require(self.rbf in ("gto", "polynomial"), "rbf is gto or polynomial", "rbf")
        self.check_weighting()
        require(self.sigma > 0 and self.n_max > 0 and 0 <= self.l_max <= 20 and self.radius > (1 if self.rbf == "gto" else 0), "r_cut is over 1 (gto), l_max 0 to 20", "r_cut")

    def check_weighting(self) -> None:
        w = self.weighting or {}
        needed = {"poly": ("c", "m"), "pow": ("c", "d", "m"), "exp": ("c", "d"), None: ()}
        require(w.get("function") in needed, "the function is poly, pow or exp", "weighting.function")
        for name in (*needed[w.get("function")], *(["w0"] if "w0" in w else [])):
            require(w.get(name, -1) >= 0, f"{name} is given and not negative", f"weighting.{name}")
        require(not w.get("function") or w.get("r0", 0) > 0 and w.get("threshold", 1e-2) > 0, "r0 and the threshold are positive", "weighting.r0")
        require(self.species_weighting is None or len(self.species_weighting) == len(self.species), "a weight per species", "species_weighting")

    @property
    def radius(self) -> float:
        w = self.weighting or {}
        kind = w.get("function")
        if self.r_cut is not None or kind is None:
            return 6.0 if self.r_cut is None else float(self.r_cut)
        if kind == "poly":
            return float(w["r0"])
        left = w["c"] / w.get("threshold", 1e-2) - w["d"]
        require(left > (1 if kind == "exp" else 0) and w.get("m", 1) > 0, "no cutoff follows from the weighting", "weighting")
        return w["r0"] * (log(left) if kind == "exp" else left ** (1 / w["m"]))

    def weights(self, e: Edges) -> np.ndarray:
        w = self.weighting or {}
        x = e.r / w.get("r0", 1.0)
        value = np.ones(len(e.r))
        if w.get("function") == "poly":
            value = np.where(x <= 1, w["c"] * np.maximum(1 + 2 * x**3 - 3 * x**2, 0.0) ** w["m"], 0.0)
        elif w.get("function") == "pow":
            value = w["c"] / (w["d"] + x ** w["m"])
        elif w.get("function") == "exp":
            value = w["c"] / (w["d"] + np.exp(-x))
        if "w0" in w:
            value = np.where(e.own, w["w0"], value)
        return value if self.species_weighting is None else value * np.array(self.species_weighting)[e.t]

    @property
    def level(self) -> str:
        return "atom" if self.average == "off" else "structure"

    @property
    def reach(self) -> float:
        """The cutoff and the distance where a Gaussian falls to a thousandth."""
        return self.radius + self.sigma * sqrt(-2 * log(1e-3))

    def blocks(self) -> list[tuple[str, int, int, bool]]:
        """(name, first and second density, whether n' starts at n); density -1 is the sum over species."""
        s, types = self.species, range(len(self.species))
        if self.compression == "mu2":
            return [("all", -1, -1, True)]
        if self.compression == "mu1nu1":
            return [(f"Z={s[a]},all", a, -1, False) for a in types]
        ends = [(a, b) for a in types for b in types if (a == b if self.compression == "crossover" else a <= b)]
        return [(f"Z={s[a]},{s[b]}", a, b, a == b) for a, b in ends]

    def labels(self) -> list[str]:
        size = range(self.n_max)
        return [f"{name} l={k} n={m},{n}" for name, _, _, half in self.blocks() for k in range(self.l_max + 1) for m in size for n in size if n >= m or not half]

    def spectrum(self, c: np.ndarray) -> np.ndarray:
        """From coefficients (rows, species, n, harmonics)."""
        # Rows come last, where products run over them without a gap.
        c = np.ascontiguousarray(np.moveaxis(c, 0, -1))
        every, parts = c.sum(0), []
        density = lambda k: every if k < 0 else c[k]
        upper = np.triu_indices(self.n_max)
        for _, a, b, half in self.blocks():
            for k in range(self.l_max + 1):
                of = slice(k * k, (k + 1) ** 2)
                p = pi * sqrt(8 / (2 * k + 1)) * np.einsum("imx,jmx->ijx", density(a)[:, of], density(b)[:, of])
                parts.append(p[upper] if half else p.reshape(-1, c.shape[-1]))
        return np.concatenate(parts).T

    def coefficients(self) -> Callable[[Edges], np.ndarray]:
        if self.rbf == "polynomial":
            return self.polynomial()
        radii, eta, types = np.linspace(1.0, self.radius, self.n_max), 1 / (2 * self.sigma**2), len(self.species)
        tables = []
        for k in range(self.l_max + 1):
            alpha = -np.log(1e-3 / radii**k) / radii**2
            root = inverse_root(0.5 * gamma(k + 1.5) * (alpha[:, None] + alpha) ** (-k - 1.5))
            tables.append((alpha * eta / (alpha + eta), eta**k * (alpha + eta) ** (-k - 1.5), root))

        def find(e: Edges) -> np.ndarray:
            y, out = harmonics(e.d, self.l_max) * self.weights(e)[:, None], []
            for k, (decay, front, root) in enumerate(tables):
                raw = front * np.exp(-decay * e.r[:, None] ** 2) * e.r[:, None] ** k
                g = pi**1.5 * raw @ root.T
                out.append(g[:, :, None] * y[:, None, k * k : (k + 1) ** 2])
            return e.by_type(np.concatenate(out, axis=2), types)

        return find

    def polynomial(self) -> Callable[[Edges], np.ndarray]:
        """By quadrature over the cutoff sphere's radius."""
        x, w = np.polynomial.legendre.leggauss(100)
        q, eta, types = self.radius * (x + 1) / 2, 1 / (2 * self.sigma**2), len(self.species)
        pair = np.add.outer(np.arange(self.n_max), np.arange(self.n_max))
        root = inverse_root(2 * self.radius ** (9.0 + pair) / ((7.0 + pair) * (8 + pair) * (9 + pair)))
        radial = root @ np.array([(self.radius - q) ** (n + 3) for n in range(self.n_max)]) * (4 * pi * w * self.radius / 2 * q * q)

        def overlapped(r: np.ndarray) -> np.ndarray:
            z, near, front, out = 2 * eta * r[:, None] * q, np.exp(-eta * (r[:, None] - q) ** 2), 1.0, []
            for k in range(self.l_max + 1):
                front = front * z / (2 * k + 1) if k else front
                out.append(front * scaled_kummer(k + 1.0, 2 * k + 2.0, 2 * z.ravel()).reshape(z.shape) * near @ radial.T)
            return np.concatenate(out, axis=1)

        every = smooth(overlapped, self.reach)

        def find(e: Edges) -> np.ndarray:
            y, g = harmonics(e.d, self.l_max) * self.weights(e)[:, None], every(np.minimum(e.r, self.reach))
            return e.by_type(np.concatenate([g[:, k * self.n_max : (k + 1) * self.n_max, None] * y[:, None, k * k : (k + 1) ** 2] for k in range(self.l_max + 1)], axis=2), types)

        return find

    def kernel(self) -> Callable[[Edges], np.ndarray]:
        find = self.coefficients()
        if self.average == "inner":
            return lambda e: find(e).reshape(len(e.zi), -1)
        return lambda e: self.spectrum(find(e))

    def averaged(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        """structure_id, features: means over atoms, each of which has its own edge."""
        rest = lambda above: self.gathered_means(structures, above)
        return mapped(structures, atoms, _streamed(self, _means(False)), "structure_id long, features array<double>", rest)

    def gathered_means(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        """The same from gathered edges, summed element by element."""
        long = self.expanded(structures, atoms).select("structure_id", F.posexplode("features").alias("feature", "value"))
        means = long.groupBy("structure_id", "feature").agg(F.avg("value").alias("value"))
        found = means.groupBy("structure_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "value"))), lambda p: p["value"]).alias("features"))
        if self.average == "outer":
            return found
        shape, spectrum = (-1, len(self.species), self.n_max, (self.l_max + 1) ** 2), self.spectrum

        def run(batches):
            import pandas as pd

            for batch in batches:
                for start in range(0, len(batch), BLOCK):
                    part = batch.iloc[start : start + BLOCK]
                    yield pd.DataFrame({"structure_id": part["structure_id"], "features": list(spectrum(np.stack(part["features"].to_numpy()).reshape(shape)))})

        return found.mapInPandas(run, "structure_id long, features array<double>")

    def plan(self, structures: DataFrame, atoms: DataFrame, least: float = 0.0) -> DataFrame:
        if self.average == "off":
            return super().plan(structures, atoms, least)
        rest = lambda above: self.gathered_means(structures, above).select("structure_id", F.posexplode("features").alias("feature", "value")).where(F.abs("value") > least)
        return mapped(structures, atoms, _streamed(self, _means(True, least)), "structure_id long, feature int, value double", rest)

    def compute(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        if self.average == "off":
            return super().compute(structures, atoms)
        none = F.array_repeat(F.lit(0.0), self.width)
        return structures.select("structure_id").join(self.averaged(structures, atoms), "structure_id", "left").select("structure_id", F.coalesce("features", none).alias("features"))


def _means(long: bool, least: float = 0.0):
    """Structures' means, whose atoms are in one part; spectra of them where the average is the inner one."""

    def finished(operator: SOAP, part: Run, sums: np.ndarray):
        import pyarrow as pa

        values, sid = sums / part.sizes[:, None], part.sid[part.starts]
        if operator.average == "inner":
            values = operator.spectrum(values.reshape(-1, len(operator.species), operator.n_max, (operator.l_max + 1) ** 2))
        if not long:
            return pa.RecordBatch.from_arrays([pa.array(sid), lists(values)], ["structure_id", "features"])
        row, feature, value = cells(values, least)
        return batch(["structure_id", "feature", "value"], [sid[row], feature, value])

    def shape(operator: SOAP, found):
        part = sums = None
        for here, own, values in found:
            if here is not part:
                if part is not None:
                    yield finished(operator, part, sums)
                part, sums = here, np.zeros((len(here.sizes), values.shape[1]))
            of = here.of()[own]
            heads = np.flatnonzero(np.diff(of, prepend=-1))
            sums[of[heads]] += np.add.reduceat(values, heads, axis=0)
        if part is not None:
            yield finished(operator, part, sums)

    return shape
