"""SQL of the local expansions of low order, from their closed forms: moments of radial functions and real harmonics.

Radial tables (powers, decays, quadrature nodes) are computed from the formulas here and stand in the SQL as numbers."""

from __future__ import annotations

from math import gamma, log, pi, sqrt

import numpy as np

TYPES = 3
PAIRS = [(a, b) for a in range(TYPES) for b in range(a, TYPES)]
#: Orthonormal real harmonics to l = 2 of a direction (ux, uy, uz), m from -l to l.
HARMONICS = [
    f"{sqrt(1 / (4 * pi))!r}", *(f"{sqrt(3 / (4 * pi))!r} * u{a}" for a in "yzx"),
    f"{sqrt(15 / (4 * pi))!r} * ux * uy", f"{sqrt(15 / (4 * pi))!r} * uy * uz", f"{sqrt(5 / (16 * pi))!r} * (3 * uz * uz - 1)", f"{sqrt(15 / (4 * pi))!r} * ux * uz", f"{sqrt(15 / (16 * pi))!r} * (ux * ux - uy * uy)",
]
ORDER = [0, 1, 1, 1, 2, 2, 2, 2, 2]
#: The centre's own edge points to the pole.
DIRECTED = "CASE WHEN d2 > 0 THEN dx / sqrt(d2) ELSE 0 END AS ux, CASE WHEN d2 > 0 THEN dy / sqrt(d2) ELSE 0 END AS uy, CASE WHEN d2 > 0 THEN dz / sqrt(d2) ELSE 1 END AS uz"
ROUND = "round(value, 6) + 0.0"


def _orthonormal(overlap: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(overlap)
    return vectors @ np.diag(values**-0.5) @ vectors.T


def _horner(coefficients: np.ndarray, x: str) -> str:
    text = f"{float(coefficients[-1])!r}::DOUBLE"
    for c in coefficients[-2::-1]:
        text = f"({text} * {x} + {float(c)!r}::DOUBLE)"
    return text


def gaussian_radial(cutoff: float, width: float, size: int, top: int, terms: int = 90) -> dict[tuple[int, int], str]:
    """For each (l, n): a power series in d2, times exp(-c d2) (c r)^l. The integral of a Gaussian with a power of r and
    a Gaussian is 1F1, whose series' terms are all positive."""
    n = np.arange(size)
    widths = cutoff * np.sqrt(np.maximum(n, 1.0)) / size
    own, c = 0.5 / widths**2, 0.5 / width**2
    norm = 1 / np.sqrt(widths ** (2 * n + 3) * np.array([gamma(k + 1.5) for k in n]) / 2)
    power = 0.5 * (3 + np.add.outer(n, n))
    overlap = 0.5 * np.outer(norm, norm) * np.vectorize(gamma)(power) / np.add.outer(own, own) ** power
    mixing = norm[:, None] * _orthonormal(overlap)
    out = {}
    for k in range(top + 1):
        series = np.zeros((size, terms))
        for m in range(size):
            a, b = 0.5 * (m + k + 3), k + 1.5
            term = (pi / width**2) ** 0.75 * gamma(a) / gamma(b) / (c + own[m]) ** a
            for t in range(terms):
                series[m, t] = term
                term *= (a + t) / (b + t) / (t + 1) * c * c / (c + own[m])
        for k_n, row in enumerate(mixing.T @ series):
            out[k, k_n] = f"exp({-c!r} * d2) * power({c!r} * sqrt(d2), {k}) * {_horner(row, 'd2')}"
    return out


def _unpivot(keys: str, values: list[str], start: str, source: str) -> str:
    cells = ", ".join(values)
    return f"SELECT {keys}, ({start} + k)::INT AS feature, {ROUND} AS value FROM (SELECT {keys}, {start} AS start, unnest([{cells}]) AS value, unnest(range({len(values)})) AS k FROM {source}) WHERE round(value, 6) <> 0".replace(f"({start} + k)", "(start + k)")


def expansions(edges: str, types: str, cutoff: float, width: float, max_radial: int, top: int) -> dict[str, str]:
    """edges: SQL up to the relation loops, the centre's own edges included. types: SQL of a species' index."""
    size = max_radial + 1
    fade = min(0.5, cutoff)
    smooth = f"CASE WHEN d2 >= {cutoff**2!r} THEN 0 WHEN sqrt(d2) <= {cutoff - fade!r} THEN 1 ELSE 0.5 * (1 + cos({pi / fade!r} * (sqrt(d2) - {cutoff - fade!r}))) END"
    radial = gaussian_radial(cutoff, width, size, top)
    functions = ", ".join(f"fade * {text} AS g{k}_{n}" for (k, n), text in radial.items())
    near = f"{edges}, near AS (SELECT *, {types.format('zi')} AS ti, {types.format('zj')} AS t, {smooth} AS fade, {DIRECTED} FROM loops), basis AS (SELECT *, {functions} FROM near)"
    cells = [(m, n) for m in range((top + 1) ** 2) for n in range(size)]
    sums = ", ".join(f"sum({HARMONICS[m]} * g{ORDER[m]}_{n}) AS c{m}_{n}" for m, n in cells)
    moments = f"{near}, moments AS (SELECT structure_id, i AS atom_index, ti, t, {sums} FROM basis GROUP BY ALL)"
    atom, block = "structure_id, atom_index", len(cells)
    power = []
    for k in range(top + 1):
        for a in range(size):
            for b in range(size):
                dot = " + ".join(f"a.c{m}_{a} * b.c{m}_{b}" for m in range(k * k, (k + 1) ** 2))
                power.append(f"{(-1) ** k / sqrt(2 * k + 1)!r} * ({dot})")
    pair = "(a.t * 3 - a.t * (a.t + 1) // 2 + b.t)"
    products = f"{moments}, products AS (SELECT a.structure_id, a.atom_index, a.ti * {len(PAIRS) * len(power)} + {pair} * {len(power)} AS head, CASE WHEN a.t = b.t THEN 1 ELSE {sqrt(2)!r} END AS w, [{', '.join(power)}] AS p FROM moments a JOIN moments b ON a.structure_id = b.structure_id AND a.atom_index = b.atom_index AND a.t <= b.t)"
    return {
        "spherical_expansion": f"{moments} {_unpivot(atom, [f'c{m}_{n}' for m, n in cells], f'ti * {TYPES * block} + t * {block}', 'moments')}",
        "soap_radial_spectrum": f"{moments} {_unpivot(atom, [f'c0_{n}' for n in range(size)], f'ti * {TYPES * size} + t * {size}', 'moments')}",
        "spherical_expansion_by_pair": f"{near} {_unpivot('structure_id, i, j, sx, sy, sz', [f'{HARMONICS[m]} * g{ORDER[m]}_{n}' for m, n in cells], '0', f'(SELECT * FROM basis WHERE d2 < {cutoff**2!r})')}",
        "soap_power_spectrum": f"{products} SELECT {atom}, (head + k)::INT AS feature, {ROUND} AS value FROM (SELECT {atom}, head, w * unnest(p) AS value, unnest(range(len(p))) AS k FROM products) WHERE round(value, 6) <> 0",
    }


def _overlap(moments: str, keys: str, n_max: int, top: int) -> str:
    """Overlap spectra from moments (keys, t, cM_N): species pairs, l, n, n' (from n on within a species)."""
    upper, every, heads, at = [], [], [], 0
    for k in range(top + 1):
        for a in range(n_max):
            for b in range(n_max):
                dot = f"{pi * sqrt(8 / (2 * k + 1))!r} * (" + " + ".join(f"a.c{m}_{a} * b.c{m}_{b}" for m in range(k * k, (k + 1) ** 2)) + ")"
                every.append(dot)
                if b >= a:
                    upper.append(dot)
    for a, b in PAIRS:
        heads.append(f"WHEN a.t = {a} AND b.t = {b} THEN {at}")
        at += len(upper) if a == b else len(every)
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    own = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"{moments}, products AS (SELECT {own}, CASE {' '.join(heads)} END AS head, CASE WHEN a.t = b.t THEN [{', '.join(upper)}] ELSE [{', '.join(every)}] END AS p FROM moments a JOIN moments b ON {on} AND a.t <= b.t) SELECT {keys}, (head + k)::INT AS feature, {ROUND} AS value FROM (SELECT {keys}, head, unnest(p) AS value, unnest(range(len(p))) AS k FROM products) WHERE round(value, 6) <> 0"


def overlaps(edges, types: str, radius: float, n_max: int, top: int, sigma: float) -> dict[str, str]:
    """edges: from a cutoff to SQL up to the relation loops."""
    eta = 1 / (2 * sigma**2)
    near = f"{edges(radius + sigma * sqrt(-2 * log(1e-3)))}, near AS (SELECT *, {types.format('zj')} AS t, sqrt(d2) AS r, {DIRECTED} FROM loops)"
    radii, functions = np.linspace(1.0, radius, n_max), []
    for k in range(top + 1):
        alpha = -np.log(1e-3 / radii**k) / radii**2
        root = _orthonormal(0.5 * gamma(k + 1.5) / np.add.outer(alpha, alpha) ** (k + 1.5))
        for n in range(n_max):
            terms = [f"{float(pi**1.5 * root[n, m] * eta**k / (alpha[m] + eta) ** (k + 1.5))!r}::DOUBLE * exp({float(-alpha[m] * eta / (alpha[m] + eta))!r}::DOUBLE * d2)" for m in range(n_max)]
            functions.append(f"power(r, {k}) * ({' + '.join(terms)}) AS g{k}_{n}")
    sums = lambda scale: ", ".join(f"{scale} * sum({HARMONICS[m]} * g{ORDER[m]}_{n}) AS c{m}_{n}" for m in range((top + 1) ** 2) for n in range(n_max))
    basis = f"{near}, basis AS (SELECT *, {', '.join(functions)} FROM near)"
    one = f"{basis}, moments AS (SELECT structure_id, i AS atom_index, t, {sums('1')} FROM basis GROUP BY ALL)"
    # Every atom has its own edge, so the centres of a structure are its atoms.
    mean = f"{basis}, sizes AS (SELECT structure_id, count(*) AS n FROM atoms GROUP BY ALL), moments AS (SELECT structure_id, t, {sums('1.0 / any_value(n)')} FROM basis JOIN sizes USING (structure_id) GROUP BY structure_id, t)"
    # Polynomial radial functions, by quadrature: modified spherical Bessel functions times exp(-z), in closed form.
    x, w = np.polynomial.legendre.leggauss(100)
    q = radius * (x + 1) / 2
    pair = np.add.outer(np.arange(n_max), np.arange(n_max))
    root = _orthonormal(2 * radius ** (9.0 + pair) / ((7.0 + pair) * (8 + pair) * (9 + pair)))
    radial = root @ np.stack([(radius - q) ** (n + 3) for n in range(n_max)]) * (2 * pi * radius * w * q * q)
    nodes = ", ".join("(" + ", ".join(f"{float(v)!r}::DOUBLE" for v in (q[i], *radial[:, i])) + ")" for i in range(len(q)))
    names = ", ".join(f"h{n}" for n in range(n_max))
    z = f"({2 * eta!r} * r * q)"
    bessel = [f"(1 - exp(-2 * {z})) / (2 * {z})", f"(({z} + 1) * exp(-2 * {z}) + {z} - 1) / (2 * {z} * {z})", f"(({z} * {z} + 3) * (1 - exp(-2 * {z})) - 3 * {z} * (1 + exp(-2 * {z}))) / (2 * power({z}, 3))"]
    scaled = ", ".join(f"CASE WHEN r > 0 THEN {text} ELSE {int(k == 0)} END * exp({-eta!r} * (r - q) * (r - q)) AS b{k}" for k, text in enumerate(bessel[: top + 1]))
    weight = f"CASE WHEN r <= {radius!r} THEN greatest(1 + 2 * power(r / {radius!r}, 3) - 3 * power(r / {radius!r}, 2), 0) ELSE 0 END"
    parts = ", ".join(f"sum(b{k} * h{n}) AS g{k}_{n}" for k in range(top + 1) for n in range(n_max))
    polynomial = f"{near}, nodes AS (SELECT * FROM (VALUES {nodes}) v(q, {names})), valued AS (SELECT structure_id, i, j, sx, sy, sz, {names}, {scaled} FROM near, nodes WHERE r <= {radius!r}), radial AS (SELECT structure_id, i, j, sx, sy, sz, {parts} FROM valued GROUP BY ALL), basis AS (SELECT near.*, {weight} AS w, COLUMNS('g\\d_\\d') FROM near JOIN radial USING (structure_id, i, j, sx, sy, sz)), moments AS (SELECT structure_id, i AS atom_index, t, {sums('1').replace('sum(', 'sum(w * ')} FROM basis GROUP BY ALL)"
    atom = "structure_id, atom_index"
    return {"soap": _overlap(one, atom, n_max, top), "soap_inner": _overlap(mean, "structure_id", n_max, top), "soap_polynomial": _overlap(polynomial, atom, n_max, top)}


def rotational(edges: str, cutoff: float, n_max: int, top: int, alpha: float) -> str:
    """The power spectrum by Chebyshev nodes, with modified spherical Bessel functions in closed form."""
    count = 10 * (n_max + top + 1)
    x = np.cos(pi * (np.arange(count) + 0.5) / count)
    q = cutoff * (x + 1) / 2
    k = np.arange(1, n_max + 1)
    edge = np.array([(2 * n + 5) * (2 * n + 6) * (2 * n + 7) for n in k], float)
    pair = np.add.outer(k, k)
    root = _orthonormal(np.sqrt(np.outer(edge, edge)) / ((5.0 + pair) * (6 + pair) * (7 + pair)))
    phi = np.stack([(cutoff - q) ** (n + 2.0) * sqrt(e / (2 * cutoff ** (2.0 * n + 7))) for n, e in zip(k, edge, strict=True)])
    radial = root @ phi * (q * q * np.exp(-alpha * q * q) * np.sqrt(1 - x * x) * pi * cutoff / (2 * count))
    nodes = ", ".join("(" + ", ".join(f"{float(v)!r}::DOUBLE" for v in (q[i], *radial[:, i])) + ")" for i in range(count))
    names = ", ".join(f"h{n}" for n in range(n_max))
    z = f"({2 * alpha!r} * r * q)"
    sinh, cosh = f"((exp({z}) - exp(-{z})) / 2)", f"((exp({z}) + exp(-{z})) / 2)"
    bessel = [f"{sinh} / {z}", f"({z} * {cosh} - {sinh}) / ({z} * {z})", f"(({z} * {z} + 3) * {sinh} - 3 * {z} * {cosh}) / power({z}, 3)"]
    parts = ", ".join(f"{sqrt(2 * sqrt(2) * pi / sqrt(2 * m + 1))!r} * sum({bessel[m]} * h{n}) AS g{m}_{n}" for m in range(top + 1) for n in range(n_max))
    weight = f"zj * {4 * pi!r} * exp({-alpha!r} * r * r) * 0.5 * (cos({pi / cutoff!r} * r) + 1)"
    sums = ", ".join(f"sum(w * {HARMONICS[m]} * g{ORDER[m]}_{n}) AS c{m}_{n}" for m in range((top + 1) ** 2) for n in range(n_max))
    values = [" + ".join(f"c{m}_{a} * c{m}_{b}" for m in range(v * v, (v + 1) ** 2)) for a in range(n_max) for b in range(a + 1) for v in range(top + 1)]
    return f"""{edges}, nodes AS (SELECT * FROM (VALUES {nodes}) v(q, {names})), near AS (SELECT *, {weight} AS w, {DIRECTED} FROM edges WHERE r > 0 AND r < {cutoff!r}),
radial AS (SELECT structure_id, i, j, sx, sy, sz, {parts} FROM near, nodes GROUP BY ALL), basis AS (SELECT near.*, COLUMNS('g\\d_\\d') FROM near JOIN radial USING (structure_id, i, j, sx, sy, sz)),
moments AS (SELECT structure_id, i AS atom_index, {sums} FROM basis GROUP BY ALL) {_unpivot('structure_id, atom_index', values, '0', 'moments')}"""
