"""Many-body tensor representations: smeared histograms of atomic numbers, distances and angles."""

from __future__ import annotations

from dataclasses import dataclass
from math import log, pi, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import erf
from ..plans.edges import neighbor_edges
from ..plans.gathered import CANDIDATES, Pairs, Run, batch, edges_of, kinds, mapped, runs, spread, volumes
from .base import Operator, require, type_index

PAIR, ANGLE = ("distance", "inverse_distance"), ("angle", "cosine")
#: Fixed value: a Gaussian counts up to this many widths from its centre.
TAIL = 8
#: Observations smeared at once.
BLOCK = 4096


def upper(a: Column, b: Column, n: int) -> Column:
    """Index of an unordered pair of 0..n-1, row by row of the upper triangle."""
    low, high = F.least(a, b), F.greatest(a, b)
    return (low * n - F.floor(low * (low + 1) / 2) + high).cast("int")


def _smeared(operator: MBTR):
    """Observations to sums by row and bin: erf is taken once at each grid edge, and a batch's rows of one feature are
    added before they leave. A bin takes part where it is within TAIL widths, as if each observation had its own list."""
    grid = operator.grid_n
    dx, tail, root = (operator.grid_max - operator.grid_min) / (grid - 1), TAIL * operator.grid_sigma, operator.grid_sigma * sqrt(2)
    factor = (1.0 if operator.normalize_gaussians else operator.grid_sigma * sqrt(2 * pi)) / dx / 2
    edges = operator.grid_min - dx / 2 + dx * np.arange(grid + 1)
    keys = operator.keys

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(start, BLOCK)
                v, w, channel = (rows.column(c).to_numpy() for c in ("v", "w", "channel"))
                low = np.clip(np.ceil((v - tail - operator.grid_min - dx / 2) / dx), 0, grid - 1).astype(int)
                high = np.clip(np.floor((v + tail - operator.grid_min + dx / 2) / dx), 0, grid - 1).astype(int)
                parts = np.diff(erf((edges - v[:, None]) / root), axis=1) * (factor * w)[:, None]
                bins = np.arange(grid)
                inside = (bins >= low[:, None]) & (bins <= high[:, None])
                named = np.stack([rows.column(k).to_numpy().astype(np.int64) for k in keys], 1)
                order = np.lexsort(named.T[::-1])
                changed = np.concatenate(([True], (np.diff(named[order], axis=0) != 0).any(1)))
                own = np.empty(len(order), int)
                own[order] = np.cumsum(changed) - 1
                width = int(channel.max()) + 1
                cell = ((own * width + channel)[:, None] * grid + bins)[inside]
                cells, at = np.unique(cell, return_inverse=True)
                sums = np.bincount(at, parts[inside], len(cells))
                which, feature = np.divmod(cells, width * grid)
                heads = named[order][changed][which]
                columns = [pa.array(heads[:, k], rows.schema.field(name).type) for k, name in enumerate(keys)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(feature.astype(np.int32)), pa.array(sums)], [*keys, "feature", "value"])

    return run


def _histograms(operator: MBTR, owner: np.ndarray, channel: np.ndarray, v: np.ndarray, w: np.ndarray, width: int):
    """Owner * width + channel (ascending), sums by bin, and which bins take part."""
    grid, dx, tail, root = operator.grid_n, (operator.grid_max - operator.grid_min) / (operator.grid_n - 1), TAIL * operator.grid_sigma, operator.grid_sigma * sqrt(2)
    factor = (1.0 if operator.normalize_gaussians else operator.grid_sigma * sqrt(2 * pi)) / dx / 2
    edges, bins = operator.grid_min - dx / 2 + dx * np.arange(grid + 1), np.arange(grid)
    kept = (w != 0) & (v >= operator.grid_min - tail) & (v <= operator.grid_max + tail)
    key, v, w = (owner * width + channel)[kept], v[kept], w[kept]
    order = np.argsort(key, kind="stable")
    key, v, w = key[order], v[order], w[order]
    which = np.cumsum(np.diff(key, prepend=-1) != 0) - 1
    keys = key[np.flatnonzero(np.diff(key, prepend=-1))]
    sums, there = np.zeros((len(keys), grid)), np.zeros((len(keys), grid), bool)
    for start in range(0, len(key), BLOCK):
        of = slice(start, start + BLOCK)
        x, at = v[of, None], which[of]
        low = np.clip(np.ceil((x - tail - operator.grid_min - dx / 2) / dx), 0, grid - 1)
        high = np.clip(np.floor((x + tail - operator.grid_min + dx / 2) / dx), 0, grid - 1)
        inside = (bins >= low) & (bins <= high)
        parts = np.where(inside, np.diff(erf((edges - x) / root), axis=1) * (factor * w[of])[:, None], 0.0)
        heads = np.flatnonzero(np.diff(at, prepend=-1))
        sums[at[heads]] += np.add.reduceat(parts, heads, axis=0)
        there[at[heads]] |= np.logical_or.reduceat(inside, heads, axis=0)
    return keys, sums, there


def _merged(found: list):
    """One of several pieces' histograms, whose keys may be the same."""
    if len(found) == 1:
        return found[0]
    keys, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    sums, there = np.zeros((len(keys), found[0][1].shape[1])), np.zeros((len(keys), found[0][1].shape[1]), bool)
    np.add.at(sums, at, np.concatenate([f[1] for f in found]))
    np.logical_or.at(there, at, np.concatenate([f[2] for f in found]))
    return keys, sums, there


def _upper(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    low, high = np.minimum(a, b), np.maximum(a, b)
    return low * n - low * (low + 1) // 2 + high


@dataclass(frozen=True)
class MBTR(Operator):
    """One histogram of grid_n bins per channel and structure; periodic structures only.

    Channels: species (atomic_number), unordered species pairs (distances), or centre species times pairs (angles, in
    degrees). A bin holds the weight of the Gaussian inside it, divided by its width."""

    species: tuple[int, ...]
    geometry: str = "distance"
    grid_min: float = 0.0
    grid_max: float = 6.0
    grid_n: int = 50
    grid_sigma: float = 0.1
    weighting: str = "exp"
    scale: float = 0.5
    threshold: float = 1e-3
    r_cut: float | None = None
    sharpness: float = 2.0
    normalize_gaussians: bool = True
    normalization: str = "none"
    level = "structure"
    periodic_only = True

    def __post_init__(self) -> None:
        require(self.geometry in ("atomic_number", *PAIR, *ANGLE), "unknown geometry", "geometry")
        require(self.weighting in ("unity", "none", "exp", "inverse_square", "smooth_cutoff"), "unknown weighting", "weighting")
        require(self.normalization in ("none", "l2", "n_atoms", "valle_oganov"), "unknown normalization", "normalization")
        require(self.grid_n >= 2 and self.grid_max > self.grid_min and self.grid_sigma > 0, "a grid has two bins, a range and a width", "grid")
        require(self.weighting != "exp" or (self.scale > 0 and 0 < self.threshold < 1), "exp weighting takes a positive scale and a threshold between 0 and 1", "weighting")
        require(self.weighting not in ("inverse_square", "smooth_cutoff") or self.asked > 0, "cutoff weighting takes a positive r_cut", "r_cut")

    @property
    def keys(self) -> list[str]:
        return ["structure_id"] if self.level == "structure" else ["structure_id", "atom_index"]

    @property
    def asked(self) -> float:
        if self.r_cut is not None:
            return float(self.r_cut)
        return float(self.grid_max) if self.weighting in ("inverse_square", "smooth_cutoff") else 0.0

    @property
    def cutoff(self) -> float:
        """Radius of the edges that can have a weight."""
        found = max(self.asked, 0.0)
        if self.weighting == "exp":
            found = max(found, (0.5 if self.geometry in ANGLE else 1.0) * -log(self.threshold) / self.scale)
        return found or float(self.grid_max)

    def channels(self) -> list[str]:
        s = self.species
        if self.geometry == "atomic_number":
            return [f"Z={z}" for z in s]
        pairs = [f"Z={s[a]},{s[b]}" for a in range(len(s)) for b in range(a, len(s))]
        return pairs if self.geometry in PAIR else [f"Z={z} of {p}" for z in s for p in pairs]

    def labels(self) -> list[str]:
        return [f"{c} #{k}" for c in self.channels() for k in range(self.grid_n)]

    def weight(self, first: Column, second: Column | float = 0.0, third: Column | float = 0.0) -> Column:
        if self.weighting == "exp":
            value = F.exp(-self.scale * (first + second + third))
            return F.when(value >= self.threshold, value).otherwise(0.0)
        if self.weighting == "inverse_square":
            return F.when(first <= self.asked, 1 / F.greatest(first * first, F.lit(1e-30))).otherwise(0.0)
        if self.weighting == "smooth_cutoff":
            return self._smooth(first) * self._smooth(second)
        return F.lit(1.0)

    def _smooth(self, r: Column | float) -> Column:
        r, s = r if isinstance(r, Column) else F.lit(r), float(self.sharpness)
        x = F.least(F.greatest(r / self.asked, F.lit(0.0)), F.lit(1.0))
        return F.when(r <= self.asked, 1 + s * F.pow(x, F.lit(s + 1)) - (s + 1) * F.pow(x, F.lit(s))).otherwise(0.0)

    def edges(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        found = neighbor_edges(structures, atoms, self.cutoff).withColumn("r", F.sqrt("d2")).where("r > 1e-12")
        return found.withColumns({"ti": type_index(F.col("zi"), self.species), "t": type_index(F.col("zj"), self.species)})

    def triplets(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        """Unordered pairs of one centre's edges: r1, r2, opposite side r3, types ti, t1, t2."""
        base = self.edges(structures, atoms).withColumn("at", F.struct("j", "sx", "sy", "sz"))
        side = lambda k: base.select("structure_id", F.col("i").alias("atom_index"), *(["ti"] if k == 1 else []), *[F.col(c).alias(f"{c}{k}") for c in ("at", "t", "r", "d2", "dx", "dy", "dz")])
        both = side(1).join(side(2), ["structure_id", "atom_index"]).where("at1 < at2")
        gap = [F.col(f"d{a}1") - F.col(f"d{a}2") for a in "xyz"]
        return both.withColumn("r3", F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]))

    def angle(self, a: Column, b: Column, opposite: Column) -> Column:
        """Between sides a and b."""
        cosine = F.when((a > 0) & (b > 0), (a * a + b * b - opposite * opposite) / (2 * a * b)).otherwise(1.0)
        cosine = F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))
        return cosine if self.geometry == "cosine" else F.acos(cosine) * (180 / pi)

    def observations(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        """keys, channel, v, w."""
        n = len(self.species)
        if self.geometry == "atomic_number":
            return atoms.select(*self.keys, type_index(F.col("z"), self.species).alias("channel"), F.col("z").cast("double").alias("v"), F.lit(1.0).alias("w"))
        if self.geometry in PAIR:
            far = (F.col("sx") != 0) | (F.col("sy") != 0) | (F.col("sz") != 0)
            edges = self.edges(structures, atoms).where(far | (F.col("j") > F.col("i")))
            return edges.select("structure_id", upper(F.col("ti"), F.col("t"), n).alias("channel"), self.measure().alias("v"), (self.weight(F.col("r")) * F.when(far, 0.5).otherwise(1.0)).alias("w"))
        r1, r2, r3 = F.col("r1"), F.col("r2"), F.col("r3")
        channel = F.col("ti") * (n * (n + 1) // 2) + upper(F.col("t1"), F.col("t2"), n)
        return self.triplets(structures, atoms).select("structure_id", channel.alias("channel"), self.angle(r1, r2, r3).alias("v"), self.weight(r1, r2, r3).alias("w"))

    def measure(self) -> Column:
        return F.col("r") if self.geometry == "distance" else 1 / F.col("r")

    def weighed(self, first: np.ndarray, second: np.ndarray | float = 0.0, third: np.ndarray | float = 0.0) -> np.ndarray:
        """weight() on arrays."""
        if self.weighting == "exp":
            value = np.exp(-self.scale * (first + second + third))
            return np.where(value >= self.threshold, value, 0.0)
        if self.weighting == "inverse_square":
            return np.where(first <= self.asked, 1 / np.maximum(first * first, 1e-30), 0.0)
        if self.weighting == "smooth_cutoff":
            s, found = float(self.sharpness), 1.0
            for r in (first, second):
                x = np.clip(r / self.asked, 0.0, 1.0)
                found = found * np.where(r <= self.asked, 1 + s * x ** (s + 1) - (s + 1) * x**s, 0.0)
            return found
        return np.ones(len(first))

    def turned(self, a: np.ndarray, b: np.ndarray, opposite: np.ndarray) -> np.ndarray:
        """angle() on arrays."""
        cosine = np.clip((a * a + b * b - opposite * opposite) / (2 * a * b), -1.0, 1.0)
        return cosine if self.geometry == "cosine" else np.arccos(cosine) * (180 / pi)

    def seen(self, part: Run, pairs: Pairs, r: np.ndarray, ti: np.ndarray, t: np.ndarray):
        """owner, channel, v, w of distances; owners are structures or, in a subclass, atoms."""
        far = pairs.s.any(1)
        kept = np.flatnonzero(far | (part.index[pairs.j] > part.index[pairs.i]))
        r, n = r[kept], len(self.species)
        v = r if self.geometry == "distance" else 1 / r
        return part.of()[pairs.i[kept]], _upper(ti[kept], t[kept], n), v, self.weighed(r) * np.where(far[kept], 0.5, 1.0)

    def seen_angles(self, part: Run, i: np.ndarray, sides: list[np.ndarray], ti: np.ndarray, a: np.ndarray, b: np.ndarray):
        n = len(self.species)
        yield part.of()[i], ti * (n * (n + 1) // 2) + _upper(a, b, n), self.turned(*sides)

    def pieces(self, part: Run, pairs: Pairs):
        """Observations of a part, of at most CANDIDATES pairs of edges or one centre's at a time."""
        r = np.sqrt(pairs.d2)
        apart = r > 1e-12
        pairs, r = Pairs(*[v[apart] for v in (pairs.i, pairs.j, pairs.s, pairs.d, pairs.d2, pairs.own)]), r[apart]
        every = np.zeros(len(part.z), int)
        near = np.concatenate([pairs.i, pairs.j])
        every[near] = kinds(part.z[near], self.species)
        ti, t = every[pairs.i], every[pairs.j]
        if self.geometry in PAIR:
            yield self.seen(part, pairs, r, ti, t)
            return
        order = np.lexsort((*pairs.s.T[::-1], part.index[pairs.j], pairs.i))
        i, r, d, ti, t = pairs.i[order], r[order], pairs.d[order], ti[order], t[order]
        heads = np.flatnonzero(np.diff(i, prepend=-1))
        ends = np.append(heads[1:], len(i))
        # Each edge with those after it about the same centre.
        after = np.repeat(ends, ends - heads) - np.arange(len(i)) - 1
        total, first = np.cumsum(np.add.reduceat(after, heads)) if len(heads) else np.zeros(0, int), 0
        while first < len(heads):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + CANDIDATES, "right")))
            low, high = heads[first], ends[last - 1]
            one, number = spread(after[low:high])
            one = one + low
            two, first = one + number + 1, last
            gap = d[one] - d[two]
            sides = [r[one], r[two], np.sqrt(gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2])]
            w = self.weighed(*sides)
            for owner, channel, v in self.seen_angles(part, i[one], sides, ti[one], t[one], t[two]):
                yield owner, channel, v, w

    def streamed(self, batches):
        width = len(self.channels())
        for run in runs(batches):
            if self.geometry == "atomic_number":
                owner = run.of() if self.level == "structure" else np.arange(len(run.z))
                pieces = [(run, [(owner, kinds(run.z, self.species), run.z.astype(float), np.ones(len(run.z)))])]
            else:
                pieces = ((part, self.pieces(part, pairs)) for part, pairs in edges_of(run, self.cutoff))
            for part, seen in pieces:
                found = [_histograms(self, *o, width) for o in seen]
                if not found:
                    continue
                keys, sums, there = _merged(found)
                owner, channel = np.divmod(keys, width)
                sums = self.scaled(part, owner, channel, sums)
                row, bin = np.nonzero(there)
                feature = (channel[row] * self.grid_n + bin).astype(np.int32)
                at = part.starts[owner[row]] if self.level == "structure" else owner[row]
                named = [part.sid[at], *([] if self.level == "structure" else [part.index[at]])]
                yield batch([*self.keys, "feature", "value"], [*named, feature, sums[row, bin]])

    def scaled(self, part: Run, owner: np.ndarray, channel: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """normalized() on arrays: an owner's histograms are all here."""
        of = owner if self.level == "structure" else part.of()[owner]
        if self.normalization == "l2":
            norm = np.sqrt(np.bincount(owner, (sums * sums).sum(1)))[owner]
            return sums / np.where(norm > 0, norm, 1.0)[:, None]
        if self.normalization == "n_atoms":
            return sums / part.sizes[of][:, None]
        if self.normalization == "valle_oganov" and self.level == "structure" and self.geometry != "atomic_number":
            counts = np.stack([np.add.reduceat((part.z == z).astype(float), part.starts) for z in self.species], 1)
            first, second = np.triu_indices(len(self.species))
            if self.geometry in PAIR:
                a, b = first[channel], second[channel]
                product = counts[of, a] * counts[of, b] * np.where(a == b, 0.5, 1.0) * (4 * pi)
            else:
                pair = channel % len(first)
                product = counts[of, channel // len(first)] * counts[of, first[pair]] * counts[of, second[pair]]
            scale = np.where(product > 0, volumes(part.cell)[of] / np.where(product > 0, product, 1.0), 1.0)
            return sums * scale[:, None]
        return sums

    def plan(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        named = ", ".join(f"{k} {'long' if k == 'structure_id' else 'int'}" for k in self.keys)
        return mapped(structures, atoms, self.streamed, f"{named}, feature int, value double", lambda above: self.gathered(structures, above))

    def gathered(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        """plan() of large structures."""
        tail = TAIL * self.grid_sigma
        seen = self.observations(structures, atoms).where(F.col("w") != 0).where(F.col("v").between(self.grid_min - tail, self.grid_max + tail))
        found = seen.select(*self.keys, F.col("channel").cast("int").alias("channel"), "v", "w").mapInArrow(_smeared(self), ", ".join(f"{k} {t}" for k, t in seen.select(*self.keys).dtypes) + ", feature int, value double")
        sums = found.groupBy(*self.keys, "feature").agg(F.sum("value").alias("value"))
        return self.normalized(sums, structures, atoms)

    def normalized(self, sums: DataFrame, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        columns = [*self.keys, "feature", "value"]
        if self.normalization == "l2":
            norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(*self.keys)))
            return sums.withColumn("norm", norm).select(*self.keys, "feature", F.when(F.col("norm") > 0, F.col("value") / F.col("norm")).otherwise(F.col("value")).alias("value"))
        if self.normalization == "n_atoms":
            sizes = atoms.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"))
            return sums.join(sizes, "structure_id").withColumn("value", F.col("value") / F.col("n")).select(*columns)
        if self.normalization == "valle_oganov" and self.level == "structure" and self.geometry != "atomic_number":
            return self._by_density(sums, structures, atoms).select(*columns)
        return sums

    def _by_density(self, sums: DataFrame, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        """Times the volume, over the number of pairs or triplets of the channel's species."""
        n = len(self.species)
        counts = atoms.groupBy("structure_id").agg(F.array(*[F.count_if(F.col("z") == z) for z in self.species]).alias("counts"))
        m = [F.get("cell", F.lit(k)) for k in range(9)]
        volume = F.abs(m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6]))
        known = structures.select("structure_id", volume.alias("volume")).join(counts, "structure_id")
        pairs = [(a, b) for a in range(n) for b in range(a, n)]
        count = lambda k: F.get("counts", F.lit(k)).cast("double")
        if self.geometry in PAIR:
            products = [count(a) * count(b) * (0.5 if a == b else 1.0) * (4 * pi) for a, b in pairs]
        else:
            products = [count(c) * count(a) * count(b) for c in range(n) for a, b in pairs]
        known = known.select("structure_id", "volume", F.array(*products).alias("products"))
        product = F.get("products", F.floor(F.col("feature") / self.grid_n).cast("int"))
        return sums.join(known, "structure_id").withColumn("value", F.when(product > 0, F.col("value") * F.col("volume") / product).otherwise(F.col("value")))


@dataclass(frozen=True)
class LMBTR(MBTR):
    """The same per atom. Channel 0 of distances is an unused ghost species; angles have the centre as their vertex
    (unordered pairs, ghost included), then as an end (other end times ghost-extended species)."""

    level = "atom"

    def channels(self) -> list[str]:
        names = ["X", *[f"Z={z}" for z in self.species]]
        if self.geometry == "atomic_number":
            return names[1:]
        if self.geometry in PAIR:
            return names
        n = len(names)
        return [f"{names[a]} X {names[b]}" for a in range(n) for b in range(a, n)] + [f"X {names[a]} {names[b]}" for a in range(1, n) for b in range(n)]

    def seen(self, part: Run, pairs: Pairs, r: np.ndarray, ti: np.ndarray, t: np.ndarray):
        return pairs.i, t + 1, r if self.geometry == "distance" else 1 / r, self.weighed(r)

    def seen_angles(self, part: Run, i: np.ndarray, sides: list[np.ndarray], ti: np.ndarray, a: np.ndarray, b: np.ndarray):
        n, (r1, r2, r3) = len(self.species) + 1, sides
        kept, a, b = n * (n + 1) // 2, a + 1, b + 1
        yield i, _upper(a, b, n), self.turned(r1, r2, r3)
        # An end that lies on the other one has no angle: its cosine is one.
        for channel, near, far in ((kept + (a - 1) * n + b, r1, r2), (kept + (b - 1) * n + a, r2, r1)):
            there = r3 > 0
            yield i, channel, np.where(there, self.turned(near, np.where(there, r3, 1.0), far), 1.0 if self.geometry == "cosine" else 0.0)

    def observations(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        if self.geometry == "atomic_number":
            return super().observations(structures, atoms)
        if self.geometry in PAIR:
            return self.edges(structures, atoms).select("structure_id", F.col("i").alias("atom_index"), (F.col("t") + 1).alias("channel"), self.measure().alias("v"), self.weight(F.col("r")).alias("w"))
        n = len(self.species) + 1
        r1, r2, r3, a, b = F.col("r1"), F.col("r2"), F.col("r3"), F.col("t1") + 1, F.col("t2") + 1
        kept = n * (n + 1) // 2
        seen = [
            F.struct(upper(a, b, n).alias("channel"), self.angle(r1, r2, r3).alias("v")),
            F.struct((kept + (a - 1) * n + b).cast("int").alias("channel"), self.angle(r1, r3, r2).alias("v")),
            F.struct((kept + (b - 1) * n + a).cast("int").alias("channel"), self.angle(r2, r3, r1).alias("v")),
        ]
        found = self.triplets(structures, atoms).select("structure_id", "atom_index", self.weight(r1, r2, r3).alias("w"), F.explode(F.array(*seen)).alias("o"))
        return found.select("structure_id", "atom_index", "o.channel", "o.v", "w")


def valle_oganov(species: tuple[int, ...], function: str = "distance", n: int = 50, sigma: float = 0.1, r_cut: float = 6.0, **changes) -> MBTR:
    """The tensor with the fingerprint's presets: distances weighted by 1/r^2, or angles with a smooth cutoff."""
    require(function in ("distance", "angle"), "function is distance or angle", "function")
    angle = function == "angle"
    preset = {"geometry": function, "grid_max": 180.0 if angle else r_cut, "grid_n": n, "grid_sigma": sigma, "weighting": "smooth_cutoff" if angle else "inverse_square", "r_cut": r_cut, "normalization": "valle_oganov"}
    return MBTR(species, **(preset | changes))


@dataclass(frozen=True)
class ValleOganov(Operator):
    """The structural fingerprint under its own name: valle_oganov's tensor of n grid points."""

    species: tuple[int, ...]
    function: str = "distance"
    n: int = 50
    sigma: float = 0.1
    r_cut: float = 6.0
    normalize_gaussians: bool = True
    normalization: str = "valle_oganov"

    level = "structure"
    periodic_only = True

    def __post_init__(self) -> None:
        require(self.n >= 2, "n is at least 2", "n")
        require(self.sigma > 0, "sigma is positive", "sigma")
        require(self.r_cut > 0, "r_cut is positive", "r_cut")
        object.__setattr__(self, "tensor", valle_oganov(self.species, self.function, self.n, self.sigma, self.r_cut, normalize_gaussians=self.normalize_gaussians, normalization=self.normalization))

    def labels(self) -> list[str]:
        return self.tensor.labels()

    def plan(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        return self.tensor.plan(structures, atoms)
