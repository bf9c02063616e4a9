"""Symmetry functions and embedded-atom densities as sums over edges and pairs of edges."""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.edges import neighbor_edges
from .base import Operator, cosine_cutoff, require, type_index

KEYS = ("structure_id", "atom_index")


@dataclass(frozen=True)
class ACSF(Operator):
    """Behler's functions G1 to G5.

    g2: (eta, rs) pairs; g3: kappas; g4 and g5: (eta, zeta, lambda) triples. Layout: for each species G1, G2..., G3...;
    then for each species pair (a >= b, at a(a+1)/2 + b) G4..., G5...; labels follow the values' order."""

    species: tuple[int, ...]
    r_cut: float = 6.0
    g2: tuple[tuple[float, float], ...] = ()
    g3: tuple[float, ...] = ()
    g4: tuple[tuple[float, float, float], ...] = ()
    g5: tuple[tuple[float, float, float], ...] = ()

    def __post_init__(self) -> None:
        require(self.r_cut > 0, "a cutoff is positive", "r_cut")

    def labels(self) -> list[str]:
        radial = ["G1", *(f"G2 eta={e} rs={r}" for e, r in self.g2), *(f"G3 kappa={k}" for k in self.g3)]
        angular = [f"{g} eta={e} zeta={z} lambda={k}" for g, rows in (("G4", self.g4), ("G5", self.g5)) for e, z, k in rows]
        s = self.species
        return [f"{x} Z={z}" for z in s for x in radial] + [f"{x} Z={s[b]},{s[a]}" for a in range(len(s)) for b in range(a + 1) for x in angular]

    def plan(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        edges = neighbor_edges(structures, atoms, self.r_cut)
        r = F.sqrt("d2")
        base = edges.select("structure_id", F.col("i").alias("atom_index"), "j", "sx", "sy", "sz", type_index(F.col("zj"), self.species).alias("t"), "dx", "dy", "dz", r.alias("r"), "d2", cosine_cutoff(r, self.r_cut).alias("fc"))
        near, fc = F.col("r"), F.col("fc")
        radial = [fc, *(F.exp(-e * (near - rs) * (near - rs)) * fc for e, rs in self.g2), *(F.cos(k * near) * fc for k in self.g3)]
        sums = base.groupBy(*KEYS, "t").agg(*[F.sum(c).alias(f"v{n}") for n, c in enumerate(radial)])
        out = sums.select(*KEYS, "t", F.posexplode(F.array(*[f"v{n}" for n in range(len(radial))])).alias("n", "value")).select(*KEYS, (F.col("t") * len(radial) + F.col("n")).alias("feature"), "value")
        if self.g4 or self.g5:
            out = out.unionByName(self._angular(base, len(radial) * len(self.species)))
        return out

    def _angular(self, base: DataFrame, start: int) -> DataFrame:
        place = F.struct("j", "sx", "sy", "sz")
        one = base.select(*KEYS, *[F.col(c).alias(f"{c}1") for c in ("t", "dx", "dy", "dz", "r", "d2", "fc")], place.alias("at1"))
        two = base.select(*KEYS, *[F.col(c).alias(f"{c}2") for c in ("t", "dx", "dy", "dz", "r", "d2", "fc")], place.alias("at2"))
        pairs = one.join(two, list(KEYS)).where(F.col("at1") < F.col("at2"))
        dot = F.col("dx1") * F.col("dx2") + F.col("dy1") * F.col("dy2") + F.col("dz1") * F.col("dz2")
        gap = [F.col(f"d{a}2") - F.col(f"d{a}1") for a in "xyz"]
        pairs = pairs.withColumns({"c": dot / (F.col("r1") * F.col("r2")), "e2": gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2], "hi": F.greatest("t1", "t2"), "lo": F.least("t1", "t2")})
        pairs = pairs.withColumn("fc3", F.when(F.col("e2") <= self.r_cut**2, cosine_cutoff(F.sqrt("e2"), self.r_cut)).otherwise(0.0))
        turn = lambda zeta, lam: 2 * F.pow(F.greatest(0.5 * (1 + lam * F.col("c")), F.lit(0.0)), F.lit(float(zeta)))
        both = F.col("fc1") * F.col("fc2")
        terms = [turn(z, lam) * F.exp(-e * (F.col("d21") + F.col("d22") + F.col("e2"))) * both * F.col("fc3") for e, z, lam in self.g4]
        terms += [turn(z, lam) * F.exp(-e * (F.col("d21") + F.col("d22"))) * both for e, z, lam in self.g5]
        sums = pairs.groupBy(*KEYS, "hi", "lo").agg(*[F.sum(t).alias(f"v{n}") for n, t in enumerate(terms)])
        long = sums.select(*KEYS, (F.col("hi") * (F.col("hi") + 1) / 2 + F.col("lo")).cast("int").alias("p"), F.posexplode(F.array(*[f"v{n}" for n in range(len(terms))])).alias("n", "value"))
        return long.select(*KEYS, (start + F.col("p") * len(terms) + F.col("n")).alias("feature"), "value")


@dataclass(frozen=True)
class EAD(Operator):
    """Embedded-atom densities: squared moments of x, y, z by total degree, summed over all degrees up to each."""

    L: int = 3
    eta: tuple[float, ...] = (0.05, 0.1, 0.5)
    Rs: tuple[float, ...] = (0.0,)
    Rc: float = 6.0

    def labels(self) -> list[str]:
        return [f"L={d} eta={e} Rs={r}" for d in range(self.L + 1) for e in self.eta for r in self.Rs]

    def plan(self, structures: DataFrame, atoms: DataFrame) -> DataFrame:
        edges = neighbor_edges(structures, atoms, self.Rc, boundary=False).where("d2 > 0")
        r = F.sqrt("d2")
        base = edges.select("structure_id", F.col("i").alias("atom_index"), "dx", "dy", "dz", r.alias("r"), (F.col("zj") * cosine_cutoff(r, self.Rc)).alias("w"))
        radial = [(e, s) for e in self.eta for s in self.Rs]
        powers = [(a, b, d - a - b) for d in range(self.L + 1) for a in range(d + 1) for b in range(d - a + 1)]
        power = lambda c, n: F.lit(1.0) if n == 0 else F.col(c) if n == 1 else F.pow(F.col(c), F.lit(float(n)))
        terms = {f"m{p}_{q}": F.col("w") * F.exp(-e * (F.col("r") - s) * (F.col("r") - s)) * power("dx", a) * power("dy", b) * power("dz", c) for p, (a, b, c) in enumerate(powers) for q, (e, s) in enumerate(radial)}
        sums = base.groupBy(*KEYS).agg(*[F.sum(t).alias(n) for n, t in terms.items()])
        out = []
        for d in range(self.L + 1):
            for q in range(len(radial)):
                inside = [F.col(f"m{p}_{q}") * F.col(f"m{p}_{q}") / float(factorial(a) * factorial(b) * factorial(c)) for p, (a, b, c) in enumerate(powers) if a + b + c <= d]
                out.append(sum(inside[1:], inside[0]) * (factorial(d) / self.Rc ** (2 * d)))
        return sums.select(*KEYS, F.posexplode(F.array(*out)).alias("feature", "value"))
