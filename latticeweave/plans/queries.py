"""Queries over the driver's tables, and the SQL that gives the same rows. Doubles are rounded alike on both sides."""

from __future__ import annotations

from math import log, pi, sqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import erf_sql, erfc_sql
from ..operators.bessel import C00PSMLFF
from ..operators.cluster import ACE
from ..operators.local import MTP, SO3, SOAP, SoapPowerSpectrum, SoapRadialSpectrum, SphericalExpansion, SphericalExpansionByPair
from ..operators.longrange import LodeSphericalExpansion
from ..operators.neural import NEP
from ..operators.pairs import AtomicComposition, CoulombMatrix, EwaldSumMatrix, NeighborList, SineMatrix, SortedDistances
from ..operators.rotational import SNAP, SO4, LBispectrum
from ..operators.symmetry import ACSF, EAD
from ..operators.tensors import LMBTR, MBTR, valle_oganov
from ..operators.turbo import SOAPTurbo
from ..sources.structures import LINEITEM_ATOMS, lineitem_structures
from . import local_sql

SPECIES, CUTOFF, EDGE = (1, 6, 8), 3.5, 12.0
#: Row length of the matrices: above the lines of any order at every scale.
ROOM = 64
SYMMETRY = ACSF(SPECIES, CUTOFF, g2=((0.5, 0.0), (1.0, 1.5)), g3=(1.0,), g4=((0.05, 1.0, 1.0), (0.05, 2.0, -1.0)), g5=((0.1, 1.0, 1.0),))
DENSITY = EAD(L=2, eta=(0.1, 0.5), Rs=(0.0,), Rc=CUTOFF)
#: Tensor queries share the edges' radius, so that one edge relation serves their SQL.
TENSORS = {
    "mbtr_atomic_number": MBTR(SPECIES, "atomic_number", 0.0, 9.0, 19, 0.3, weighting="unity", normalization="n_atoms"),
    "mbtr_distance": MBTR(SPECIES, grid_max=CUTOFF, grid_n=20, grid_sigma=0.2, scale=2.0, normalization="l2"),
    "mbtr_angle": MBTR(SPECIES, "angle", grid_max=180.0, grid_n=19, grid_sigma=8.0, weighting="smooth_cutoff", r_cut=CUTOFF),
    "valle_oganov_distance": valle_oganov(SPECIES, n=20, sigma=0.2, r_cut=CUTOFF),
    "valle_oganov_angle": valle_oganov(SPECIES, "angle", n=19, sigma=8.0, r_cut=CUTOFF),
    "lmbtr_distance": LMBTR(SPECIES, "inverse_distance", grid_max=2.0, grid_n=20, grid_sigma=0.1, weighting="inverse_square", r_cut=CUTOFF, normalize_gaussians=False),
    "lmbtr_angle": LMBTR(SPECIES, "cosine", grid_min=-1.0, grid_max=1.0, grid_n=11, grid_sigma=0.1, weighting="smooth_cutoff", r_cut=CUTOFF),
}


def neural_model(radial: int = 4, angular: int = 3, basis: int = 6, l_max: int = 4, neurons: int = 10, many_body: bool = True) -> str:
    """A screened model of the queries' elements with drawn numbers: no trained one comes with the package."""
    width, pairs = radial + 1 + (angular + 1) * (l_max + 2 * many_body), len(SPECIES) ** 2
    count = (width + 2) * neurons * len(SPECIES) + 1 + pairs * (basis + 1) * (radial + angular + 2)
    numbers = [*np.random.default_rng(4).normal(scale=0.1, size=count), *[1.0] * width]
    head = f"nep4_zbl {len(SPECIES)} H C O\nzbl 0.5 1.0\ncutoff {CUTOFF} 3.0 500 200\nn_max {radial} {angular}\nbasis_size {basis} {basis}\nl_max {l_max} {2 * many_body} {1 * many_body}\nANN {neurons} 0\n"
    return head + "\n".join(f"{v:.9e}" for v in numbers)


#: Of these the local expansions have SQL; the others are compared with quadrature and plain loops by tests.
EXPANDED = ("spherical_expansion", "spherical_expansion_by_pair", "soap_radial_spectrum", "soap_power_spectrum", "soap", "soap_inner", "soap_polynomial", "so3")
LOCAL = {
    "spherical_expansion": SphericalExpansion(SPECIES, CUTOFF, 0.5, 3, 2),
    "spherical_expansion_by_pair": SphericalExpansionByPair(SPECIES, CUTOFF, 0.5, 3, 2),
    "soap_radial_spectrum": SoapRadialSpectrum(SPECIES, CUTOFF, 0.5, 3),
    "soap_power_spectrum": SoapPowerSpectrum(SPECIES, CUTOFF, 0.5, 3, 2),
    "soap": SOAP(SPECIES, CUTOFF, 3, 2, 0.5, "off"),
    "soap_inner": SOAP(SPECIES, CUTOFF, 3, 2, 0.5),
    "so3": SO3(2, 2, CUTOFF),
    "so4": SO4(2, CUTOFF),
    "snap": SNAP(2, CUTOFF, element_weights=((6, 0.5), (8, 0.8))),
    "lbispectrum": LBispectrum(twojmax=4, rcut=CUTOFF),
    "nep": NEP(neural_model()),
    "c00ps_mlff": C00PSMLFF(SPECIES, CUTOFF, 4, 2),
    "soap_polynomial": SOAP(SPECIES, CUTOFF, 3, 2, 0.5, "off", rbf="polynomial", weighting={"function": "poly", "r0": CUTOFF, "c": 1.0, "m": 1.0}),
    "soap_turbo": SOAPTurbo(SPECIES, 3, 2, CUTOFF, CUTOFF - 0.5, compression="trivial"),
    "ace": ACE(SPECIES, N=3, maxdeg=5.0, rcut=CUTOFF),
}

TENSOR_MOMENTS = MTP(SPECIES, max_dist=CUTOFF, radial_basis_size=2)
#: Of low angular order, where the invariants are short in SQL.
NEURAL = NEP(neural_model(angular=2, basis=4, l_max=2, many_body=False))


#: Values up to it are zero when they are rounded: a little below half of the last digit.
NOTHING = 4.9e-7
#: Below it a value's digits fit a double's whole numbers; beyond, and where it isn't finite, decimals are used.
PLAIN = 1e9


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Halves away from zero, as SQL has it, without a decimal per value."""

    def near(c: str):
        v, scale = F.col(c), 10.0**digits
        whole = F.when(v >= 0, F.floor(v * scale + 0.5)).otherwise(F.ceil(v * scale - 0.5))
        return F.when(F.abs(v) < PLAIN, whole / F.lit(scale)).otherwise(F.round(v, digits) + 0.0)

    return df.select(*[near(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _query(make, periodic: bool | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        structures, atoms = lineitem_structures(spark, sf_dir, EDGE, periodic)
        operator = make() if callable(make) else make
        operator.check(structures)
        return rounded(operator.plan(structures, atoms))

    return run


def _cells(operator):
    """plan()'s rows whose rounded value isn't zero: sums that are zero but for rounding errors have no row."""
    return lambda spark, sf_dir: rounded(operator.plan(*lineitem_structures(spark, sf_dir, EDGE), least=NOTHING)).where("value <> 0")


def _dense(operator):
    """One row per atom, pair or structure, features as an array."""
    return lambda spark, sf_dir: operator.compute(*lineitem_structures(spark, sf_dir))


QUERIES = {
    "acsf_g2": _query(ACSF(SPECIES, CUTOFF, g2=((0.5, 0.0), (1.0, 1.5)))),
    "acsf": _query(SYMMETRY),
    "ead": _query(DENSITY),
    "atomic_composition": _query(AtomicComposition(SPECIES)),
    "atomic_composition_per_atom": _query(AtomicComposition(SPECIES, per_system=False)),
    "neighbor_list": _query(NeighborList(CUTOFF)),
    "neighbor_list_half": _query(NeighborList(CUTOFF, full_neighbor_list=False, self_pairs=True)),
    "sorted_distances": _query(SortedDistances(SPECIES, CUTOFF, 4)),
    "sorted_distances_all": _query(SortedDistances(SPECIES, CUTOFF, 4, separate_neighbor_types=False)),
    "coulomb_matrix": _query(CoulombMatrix(ROOM, "none")),
    "coulomb_matrix_sorted": _query(CoulombMatrix(ROOM)),
    "sine_matrix": _query(SineMatrix(ROOM, "none"), periodic=True),
    "sine_matrix_spectrum": _query(SineMatrix(ROOM, "eigenspectrum"), periodic=True),
    "ewald_sum_matrix": _query(EwaldSumMatrix(ROOM, "none"), periodic=True),
    "mtp": _query(TENSOR_MOMENTS),
    "nep_low": _query(NEURAL),
    "nep_predict": lambda spark, sf_dir: rounded(LOCAL["nep"].predict(*lineitem_structures(spark, sf_dir))),
    "lode_spherical_expansion": _query(LodeSphericalExpansion(SPECIES, CUTOFF, 0.5, 2, 2, 1.5), periodic=True),
    **{name: (_cells if name in EXPANDED else _dense)(operator) for name, operator in LOCAL.items()},
    **{name: _query(operator, periodic=True) for name, operator in TENSORS.items()},
}

_ATOMS = "atoms AS (" + LINEITEM_ATOMS.format(lineitem="lineitem") + "\n)"


def _edge_sql(only: str = "", cutoff: float = CUTOFF) -> str:
    """Up to edges, without the centre's own, which loops holds. only: which pairs and shifts take part."""
    return f"""{_ATOMS},
shift AS (SELECT a.s AS sx, b.s AS sy, c.s AS sz FROM (VALUES (-1), (0), (1)) a(s), (VALUES (-1), (0), (1)) b(s), (VALUES (-1), (0), (1)) c(s)),
every AS (SELECT p.structure_id, p.atom_index AS i, q.atom_index AS j, p.z AS zi, q.z AS zj, sx, sy, sz,
          q.x + sx * {EDGE} - p.x AS dx, q.y + sy * {EDGE} - p.y AS dy, q.zc + sz * {EDGE} - p.zc AS dz
          FROM atoms p JOIN atoms q USING (structure_id), shift{only}),
loops AS (SELECT *, dx * dx + dy * dy + dz * dz AS d2 FROM every WHERE dx * dx + dy * dy + dz * dz <= {cutoff**2}),
edges AS (SELECT *, sqrt(d2) AS r, 0.5 * (cos(sqrt(d2) * {pi / cutoff!r}) + 1) AS fc, CASE zj WHEN 1 THEN 0 WHEN 6 THEN 1 ELSE 2 END AS t
          FROM loops WHERE NOT (i = j AND sx = 0 AND sy = 0 AND sz = 0))"""


_MIXED = " WHERE p.structure_id % 2 = 0 OR (sx = 0 AND sy = 0 AND sz = 0)"
_EDGES, _PERIODIC_EDGES = _edge_sql(_MIXED), _edge_sql()
_R = "round({0}, 6) + 0.0"


def _radial(terms: list[str]) -> str:
    n = len(terms)
    parts = [f"SELECT structure_id, i AS atom_index, t * {n} + {k} AS feature, sum({x}) AS value FROM edges GROUP BY ALL" for k, x in enumerate(terms)]
    return " UNION ALL ".join(parts)


_G2 = ["fc", "exp(-0.5 * (r - 0.0) * (r - 0.0)) * fc", "exp(-1.0 * (r - 1.5) * (r - 1.5)) * fc"]
_ANGULAR = [
    "2 * power(greatest(0.5 * (1 + c), 0), 1.0) * exp(-0.05 * (d21 + d22 + e2)) * fc1 * fc2 * fc3",
    "2 * power(greatest(0.5 * (1 - c), 0), 2.0) * exp(-0.05 * (d21 + d22 + e2)) * fc1 * fc2 * fc3",
    "2 * power(greatest(0.5 * (1 + c), 0), 1.0) * exp(-0.1 * (d21 + d22)) * fc1 * fc2",
]
_TRIPLETS = f"""tri AS (SELECT *, CASE WHEN e2 <= {CUTOFF**2} THEN 0.5 * (cos(sqrt(e2) * {pi / CUTOFF!r}) + 1) ELSE 0 END AS fc3 FROM (
  SELECT a.structure_id, a.i AS atom_index, greatest(a.t, b.t) AS hi, least(a.t, b.t) AS lo, a.d2 AS d21, b.d2 AS d22, a.fc AS fc1, b.fc AS fc2,
         (a.dx * b.dx + a.dy * b.dy + a.dz * b.dz) / (a.r * b.r) AS c,
         (b.dx - a.dx) * (b.dx - a.dx) + (b.dy - a.dy) * (b.dy - a.dy) + (b.dz - a.dz) * (b.dz - a.dz) AS e2
  FROM edges a JOIN edges b ON a.structure_id = b.structure_id AND a.i = b.i AND (a.j, a.sx, a.sy, a.sz) < (b.j, b.sx, b.sy, b.sz)))"""
_LONG = f"SELECT structure_id, atom_index, feature::INT AS feature, {_R.format('value')} AS value FROM"


def _acsf_sql() -> str:
    angular = " UNION ALL ".join(f"SELECT structure_id, atom_index, 12 + (hi * (hi + 1) // 2 + lo) * 3 + {k} AS feature, sum({x}) AS value FROM tri GROUP BY ALL" for k, x in enumerate(_ANGULAR))
    return f"WITH {_EDGES}, {_TRIPLETS} {_LONG} ({_radial([*_G2, 'cos(1.0 * r) * fc'])} UNION ALL {angular})"


def _ead_sql() -> str:
    powers = [(a, b, d - a - b) for d in range(3) for a in range(d + 1) for b in range(d - a + 1)]
    fact = (1, 1, 2)
    sums, out = [], []
    for q, eta in enumerate((0.1, 0.5)):
        sums += [f"sum(zj * fc * exp(-{eta} * r * r) * power(dx, {a}) * power(dy, {b}) * power(dz, {c})) AS m{p}_{q}" for p, (a, b, c) in enumerate(powers)]
    for d in range(3):
        for q in range(2):
            inside = " + ".join(f"m{p}_{q} * m{p}_{q} / {fact[a] * fact[b] * fact[c]}" for p, (a, b, c) in enumerate(powers) if a + b + c <= d)
            out.append(f"SELECT structure_id, atom_index, {d * 2 + q} AS feature, ({inside}) * {fact[d]} / power({CUTOFF}, {2 * d}) AS value FROM m")
    return f"WITH {_EDGES}, m AS (SELECT structure_id, i AS atom_index, {', '.join(sums)} FROM edges WHERE d2 > 0 AND d2 < {CUTOFF**2} GROUP BY ALL) {_LONG} ({' UNION ALL '.join(out)})"


def _sorted_sql(group: str) -> str:
    return f"""WITH {_EDGES}, n AS (SELECT structure_id, i, {group} AS g, r, row_number() OVER (PARTITION BY structure_id, i, {group} ORDER BY r) AS k FROM edges),
g AS (SELECT structure_id, i, g, list(r ORDER BY r) AS rs FROM n WHERE k <= 4 GROUP BY ALL)
SELECT structure_id, i AS atom_index, (g * 4 + k)::INT AS feature, {_R.format(f'coalesce(rs[k + 1], {CUTOFF})')} AS value FROM g, (VALUES (0), (1), (2), (3)) v(k)"""


_PAIRS = f"""WITH {_ATOMS}, p AS (SELECT a.structure_id, a.atom_index AS i, b.atom_index AS j, a.z AS zi, b.z AS zj, a.x - b.x AS dx, a.y - b.y AS dy, a.zc - b.zc AS dz
FROM atoms a JOIN atoms b USING (structure_id)), m AS (SELECT structure_id, i, j, CASE WHEN i = j THEN 0.5 * power(zi, 2.4) ELSE zi * zj / sqrt(dx * dx + dy * dy + dz * dz) END AS value FROM p)"""
_NEIGHBORS = f"SELECT structure_id, i, j, sx, sy, sz, {', '.join(f'{_R.format(c)} AS {c}' for c in ('dx', 'dy', 'dz'))}, {_R.format('sqrt(d2)')} AS distance FROM"

_FAR = "(sx <> 0 OR sy <> 0 OR sz <> 0)"
_TYPES = "CASE {0} WHEN 1 THEN 0 WHEN 6 THEN 1 ELSE 2 END"
_SMOOTH = f"(1 + 2 * power({{0}} / {CUTOFF}, 3) - 3 * power({{0}} / {CUTOFF}, 2))"
_SIDES = f"""sides AS (SELECT a.structure_id, a.i AS atom_index, {_TYPES.format('a.zi')} AS ti, a.t AS t1, b.t AS t2, a.r AS r1, b.r AS r2,
  sqrt(power(a.dx - b.dx, 2) + power(a.dy - b.dy, 2) + power(a.dz - b.dz, 2)) AS r3, {_SMOOTH.format('a.r')} * {_SMOOTH.format('b.r')} AS w
  FROM edges a JOIN edges b ON a.structure_id = b.structure_id AND a.i = b.i AND (a.j, a.sx, a.sy, a.sz) < (b.j, b.sx, b.sy, b.sz))"""


def _upper(a: str, b: str, n: int) -> str:
    return f"(least({a}, {b}) * {n} - least({a}, {b}) * (least({a}, {b}) + 1) // 2 + greatest({a}, {b}))"


def _cosine(a: str, b: str, c: str) -> str:
    return f"greatest(-1, least(1, CASE WHEN {a} * {b} > 0 THEN ({a} * {a} + {b} * {b} - {c} * {c}) / (2 * {a} * {b}) ELSE 1 END))"


def _histogram(op: MBTR, obs: str, scaled: str = "value", extra: str = "") -> str:
    """obs: structure_id (and atom_index), channel, v, w. scaled: the value after normalization, over the rows h."""
    keys = ", ".join(op.keys)
    dx, tail, last, root = (op.grid_max - op.grid_min) / (op.grid_n - 1), 8 * op.grid_sigma, op.grid_n - 1, op.grid_sigma * sqrt(2)
    low = f"least({last}, greatest(0, ceil((v - {tail!r} - {op.grid_min!r} - {dx / 2!r}) / {dx!r})))::INT"
    high = f"greatest(0, least({last}, floor((v + {tail!r} - {op.grid_min!r} + {dx / 2!r}) / {dx!r})))::INT"
    factor = (1.0 if op.normalize_gaussians else op.grid_sigma * sqrt(2 * pi)) / dx / 2
    return f"""WITH {_PERIODIC_EDGES}, {_SIDES}, obs AS ({obs}),
spread AS (SELECT {keys}, channel, v, w, unnest(range({low}, {high} + 1)) AS bin FROM obs WHERE w <> 0 AND v BETWEEN {op.grid_min - tail!r} AND {op.grid_max + tail!r}),
ends AS (SELECT {keys}, channel, bin, w, ({op.grid_min - dx / 2!r}::DOUBLE + bin * {dx!r} - v) / {root!r}::DOUBLE AS a FROM spread),
both_ends AS (SELECT *, a + {dx / root!r}::DOUBLE AS b FROM ends),
h AS (SELECT {keys}, channel, bin, sum(w * {factor!r} * ({erf_sql('b', '')} - {erf_sql('a', '')})) AS value FROM both_ends GROUP BY {keys}, channel, bin){extra}
SELECT {keys}, (channel * {op.grid_n} + bin)::INT AS feature, {_R.format(scaled)} AS value FROM h"""


_DENSITY_OF = f""", counts AS (SELECT structure_id, list_value(count(*) FILTER (z = 1), count(*) FILTER (z = 6), count(*) FILTER (z = 8)) AS n FROM atoms GROUP BY ALL),
pair AS (SELECT * FROM (VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 1), (4, 1, 2), (5, 2, 2)) p(p, pa, pb))"""
_N = "(SELECT n FROM counts c WHERE c.structure_id = h.structure_id)"
_PA, _PB = (f"(SELECT {c} + 1 FROM pair WHERE p = channel % 6)" for c in ("pa", "pb"))
_VO_PAIR = f"value * {EDGE**3!r} / ({4 * pi!r} * {_N}[{_PA}] * {_N}[{_PB}] * CASE WHEN {_PA} = {_PB} THEN 0.5 ELSE 1 END)"
_VO_ANGLE = f"value * {EDGE**3!r} / ({_N}[{_PA}] * {_N}[{_PB}] * {_N}[channel // 6 + 1])"
_PAIRED = f"SELECT structure_id, {_upper(_TYPES.format('zi'), 't', 3)} AS channel, r AS v, {{0}} * CASE WHEN {_FAR} THEN 0.5 ELSE 1 END AS w FROM edges WHERE r > 1e-12 AND ({_FAR} OR j > i)"
_ANGLES = f"SELECT structure_id, ti * 6 + {_upper('t1', 't2', 3)} AS channel, degrees(acos({_cosine('r1', 'r2', 'r3')})) AS v, w FROM sides"
_LOCAL_ANGLES = " UNION ALL ".join(
    f"SELECT structure_id, atom_index, {channel} AS channel, {_cosine(*sides)} AS v, w FROM sides"
    for channel, sides in ((_upper("(t1 + 1)", "(t2 + 1)", 4), ("r1", "r2", "r3")), ("10 + t1 * 4 + t2 + 1", ("r1", "r3", "r2")), ("10 + t2 * 4 + t1 + 1", ("r2", "r3", "r1")))
)
_SCREENING, _WAVES = sqrt(-log(1e-5)), f"{2 * pi / EDGE!r}"
_EWALD = f"""WITH {_ATOMS}, k AS (SELECT structure_id, {sqrt(pi)!r} * power(count(*) / {EDGE**6!r}::DOUBLE, 1.0::DOUBLE / 6) AS alpha FROM atoms GROUP BY ALL),
p AS (SELECT k.*, a.atom_index AS i, b.atom_index AS j, a.z * b.z * CASE WHEN a.atom_index = b.atom_index THEN 0.5 ELSE 1 END AS q, a.z AS zi,
      b.x - a.x AS dx, b.y - a.y AS dy, b.zc - a.zc AS dz FROM atoms a JOIN atoms b USING (structure_id) JOIN k USING (structure_id)),
s AS (SELECT unnest(range(-3, 4)) AS s), g AS (SELECT {_WAVES} * a.s AS gx, {_WAVES} * b.s AS gy, {_WAVES} * c.s AS gz FROM s a, s b, s c WHERE a.s <> 0 OR b.s <> 0 OR c.s <> 0),
near AS (SELECT structure_id, i, j, q, alpha, sqrt(power(dx + a.s * {EDGE}, 2) + power(dy + b.s * {EDGE}, 2) + power(dz + c.s * {EDGE}, 2)) AS r FROM p, s a, s b, s c),
scaled AS (SELECT *, alpha * r AS u FROM near WHERE r > 1e-8 AND r <= {_SCREENING!r} / alpha),
parts AS (SELECT structure_id, i, j, q * {erfc_sql('u', '')} / r AS value FROM scaled
  UNION ALL SELECT structure_id, i, j, q * {4 * pi / EDGE**3!r}::DOUBLE * exp(-(gx * gx + gy * gy + gz * gz) / (4 * alpha * alpha)) / (gx * gx + gy * gy + gz * gz) * cos(gx * dx + gy * dy + gz * dz)
  FROM p, g WHERE gx * gx + gy * gy + gz * gz <= power(2 * alpha * {_SCREENING!r}, 2)
  UNION ALL SELECT structure_id, i, j, -q * {pi / EDGE**3!r}::DOUBLE / (alpha * alpha) - CASE WHEN i = j THEN alpha / {sqrt(pi)!r} * zi * zi ELSE 0 END FROM p)
SELECT structure_id, (i * {ROOM} + j)::INT AS feature, {_R.format('sum(value)')} AS value FROM parts GROUP BY structure_id, i, j"""

_DIRECTED = "dx / r AS ux, dy / r AS uy, dz / r AS uz"
_MOMENTS = "sum(g) AS m, sum(g * ux) AS x, sum(g * uy) AS y, sum(g * uz) AS z, sum(g * ux * ux) AS xx, sum(g * uy * uy) AS yy, sum(g * uz * uz) AS zz, sum(g * ux * uy) AS xy, sum(g * ux * uz) AS xz, sum(g * uy * uz) AS yz"
_DOTS = ("a.m * b.m", "a.x * b.x + a.y * b.y + a.z * b.z", "a.xx * b.xx + a.yy * b.yy + a.zz * b.zz + 2 * (a.xy * b.xy + a.xz * b.xz + a.yz * b.yz)")


def _moment_sql() -> str:
    """Two radial functions a species, ranks to two: traces, then dot products of channel pairs."""
    parts = [f"SELECT structure_id, atom_index, c * 2 + {k} AS feature, m AS value FROM moments" for k in range(2)]
    both = "FROM moments a JOIN moments b ON a.structure_id = b.structure_id AND a.atom_index = b.atom_index AND a.c <= b.c"
    parts += [f"SELECT a.structure_id, a.atom_index, {12 + 21 * k} + a.c * 6 - a.c * (a.c - 1) // 2 + b.c - a.c AS feature, {dot} AS value {both}" for k, dot in enumerate(_DOTS)]
    return f"""WITH {_EDGES}, e AS (SELECT *, {_DIRECTED}, power(0.5 * (1 + cos({pi!r} * r / {CUTOFF})), 2) * CASE n WHEN 0 THEN 1 ELSE 2 * r / {CUTOFF} - 1 END AS g FROM edges, (VALUES (0), (1)) k(n)),
moments AS (SELECT structure_id, i AS atom_index, t * 2 + n AS c, {_MOMENTS} FROM e GROUP BY ALL)
SELECT structure_id, atom_index, feature::INT AS feature, {_R.format("value")} AS value FROM ({" UNION ALL ".join(parts)}) WHERE value <> 0"""


def _neural_sql() -> str:
    """Radial sums, then the first two Legendre sums over pairs of neighbours, from moments."""
    model = NEURAL.parsed
    rows = [f"({a}, {b}, {part}, {n}, {k}, {float(v)!r})" for part, table in enumerate((model.radial, model.angular)) for (a, b, n, k), v in np.ndenumerate(table)]
    radial, angular = model.radial.shape[2], model.angular.shape[2]
    x = "2 * power(r / rc - 1, 2) - 1"
    first = f"SELECT structure_id, atom_index, n AS feature, m AS value FROM moments WHERE part = 0"
    one, two = (f"SELECT a.structure_id, a.atom_index, {radial + k * angular} + a.n AS feature, {v} AS value FROM moments a JOIN moments b USING (structure_id, atom_index, part, n) WHERE part = 1" for k, v in enumerate((f"{3 / (4 * pi)!r} * ({_DOTS[1]})", f"{5 / (4 * pi)!r} * (1.5 * ({_DOTS[2]}) - 0.5 * a.m * b.m)")))
    return f"""WITH {_EDGES}, c AS (SELECT * FROM (VALUES {", ".join(rows)}) v(ti, t, part, n, k, w)),
near AS (SELECT edges.*, {_TYPES.format("zi")} AS ti, part, rc, {_DIRECTED} FROM edges, (VALUES (0, {CUTOFF}::DOUBLE), (1, 3.0::DOUBLE)) p(part, rc) WHERE r < rc),
e AS (SELECT structure_id, i, j, sx, sy, sz, part, n, any_value(ux) AS ux, any_value(uy) AS uy, any_value(uz) AS uz,
      sum(w * 0.5 * (cos(k * acos(greatest(-1, least(1, {x})))) + 1) * (0.5 * cos({pi!r} * r / rc) + 0.5)) AS g FROM near JOIN c USING (ti, t, part) GROUP BY structure_id, i, j, sx, sy, sz, part, n),
moments AS (SELECT structure_id, i AS atom_index, part, n, {_MOMENTS} FROM e GROUP BY ALL)
SELECT structure_id, atom_index, feature::INT AS feature, {_R.format("value")} AS value FROM ({first} UNION ALL {one} UNION ALL {two}) WHERE value <> 0"""


ORACLE_SQL = {
    "mtp": _moment_sql(),
    "nep_low": _neural_sql(),
    "ewald_sum_matrix": _EWALD,
    "mbtr_atomic_number": _histogram(TENSORS["mbtr_atomic_number"], f"SELECT structure_id, {_TYPES.format('z')} AS channel, z::DOUBLE AS v, 1 AS w FROM atoms", "value / (SELECT count(*) FROM atoms a WHERE a.structure_id = h.structure_id)"),
    "mbtr_distance": _histogram(TENSORS["mbtr_distance"], _PAIRED.format("CASE WHEN exp(-2.0 * r) >= 1e-3 THEN exp(-2.0 * r) ELSE 0 END"), "value / sqrt(sum(value * value) OVER (PARTITION BY structure_id))"),
    "mbtr_angle": _histogram(TENSORS["mbtr_angle"], _ANGLES),
    "valle_oganov_distance": _histogram(TENSORS["valle_oganov_distance"], _PAIRED.format("1 / (r * r)"), _VO_PAIR, _DENSITY_OF),
    "valle_oganov_angle": _histogram(TENSORS["valle_oganov_angle"], _ANGLES, _VO_ANGLE, _DENSITY_OF),
    "lmbtr_distance": _histogram(TENSORS["lmbtr_distance"], "SELECT structure_id, i AS atom_index, t + 1 AS channel, 1 / r AS v, 1 / (r * r) AS w FROM edges WHERE r > 1e-12"),
    "lmbtr_angle": _histogram(TENSORS["lmbtr_angle"], _LOCAL_ANGLES),
    "acsf_g2": f"WITH {_EDGES} {_LONG} ({_radial(_G2)})",
    "acsf": _acsf_sql(),
    "ead": _ead_sql(),
    "atomic_composition": f"WITH {_ATOMS} SELECT structure_id, CASE z WHEN 1 THEN 0 WHEN 6 THEN 1 ELSE 2 END AS feature, count(*)::DOUBLE AS value FROM atoms GROUP BY ALL",
    "atomic_composition_per_atom": f"WITH {_ATOMS} SELECT structure_id, atom_index, CASE z WHEN 1 THEN 0 WHEN 6 THEN 1 ELSE 2 END AS feature, count(*)::DOUBLE AS value FROM atoms GROUP BY ALL",
    "neighbor_list": f"WITH {_EDGES} {_NEIGHBORS} edges",
    "neighbor_list_half": f"WITH {_EDGES} {_NEIGHBORS} loops WHERE j > i OR (i = j AND CASE WHEN sx <> 0 THEN sx WHEN sy <> 0 THEN sy ELSE sz END >= 0)",
    "sorted_distances": _sorted_sql("t"),
    "sorted_distances_all": _sorted_sql("0"),
    "coulomb_matrix": f"{_PAIRS} SELECT structure_id, (i * {ROOM} + j)::INT AS feature, {_R.format('value')} AS value FROM m",
    "coulomb_matrix_sorted": f"""{_PAIRS}, n AS (SELECT structure_id, i, row_number() OVER (PARTITION BY structure_id ORDER BY printf('%.12e', sum(value * value))::DOUBLE DESC, i) - 1 AS k FROM m GROUP BY structure_id, i)
SELECT m.structure_id, (a.k * {ROOM} + b.k)::INT AS feature, {_R.format('value')} AS value FROM m JOIN n a ON m.structure_id = a.structure_id AND m.i = a.i JOIN n b ON m.structure_id = b.structure_id AND m.j = b.i""",
    "sine_matrix": f"""{_PAIRS}, s AS (SELECT *, {EDGE} * sqrt(power(sin({pi!r} * dx / {EDGE}), 4) + power(sin({pi!r} * dy / {EDGE}), 4) + power(sin({pi!r} * dz / {EDGE}), 4)) AS r FROM p)
SELECT structure_id, (i * {ROOM} + j)::INT AS feature, {_R.format('CASE WHEN i = j THEN 0.5 * power(zi, 2.4) WHEN r > 1e-14 THEN zi * zj / r ELSE 0 END')} AS value FROM s""",
}
ORACLE_SQL |= {
    **{k: v for k, v in local_sql.expansions(f"WITH {_EDGES}", _TYPES, CUTOFF, 0.5, 3, 2).items()},
    **local_sql.overlaps(lambda cutoff: f"WITH {_edge_sql(_MIXED, cutoff)}", _TYPES, CUTOFF, 3, 2, 0.5),
    "so3": local_sql.rotational(f"WITH {_EDGES}", CUTOFF, 2, 2, 2.0),
}
