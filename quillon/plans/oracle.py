"""SQL that says the same as the queries, written out for two inducing points and two dimensions, unit parameters."""

from __future__ import annotations

import math

Z = ((-0.5, -0.5), (0.5, 0.5))
K12 = math.exp(-1.0)
KI = (1 / (1 - K12**2), -K12 / (1 - K12**2))  # of the diagonal, off it

LINES = """L as (select (l_quantity - 25.5) / 14.5 as x0, (l_discount - 0.05) / 0.03 as x1, (l_extendedprice - 53000) / 30000 as y0, (l_tax - 0.04) / 0.024 as y1,
  {s} as s, l_suppkey % 4 as shard from lineitem)"""
CUSTOMERS = "L as (select c_custkey as row_id, (c_acctbal - 4500) / 3000 as x0, (c_nationkey - 12) / 7 as x1, (c_acctbal - 4500) / 3000 as y0, (c_nationkey - 12) / 7 as y1, 0.5 as s from customer)"


def one(m: int) -> str:
    return "exp(-0.5 * (" + " + ".join(f"({z} - x{q}) * ({z} - x{q}) / (s + 1)" for q, z in enumerate(Z[m])) + ")) / (s + 1)"


def two(m: int, k: int) -> str:
    still = 0.25 * sum((a - b) ** 2 for a, b in zip(Z[m], Z[k], strict=True))
    return f"exp(-{still} - (" + " + ".join(f"(x{q} - {(a + b) / 2}) * (x{q} - {(a + b) / 2}) / (2 * s + 1)" for q, (a, b) in enumerate(zip(Z[m], Z[k], strict=True))) + ")) / (2 * s + 1)"


def by_z1(m: int, q: int, i: int) -> str:
    return f"{one(m)} * (x{q} - ({Z[m][q]})) / (s + 1) * y{i}"


def by_a1(q: int, m: int, i: int) -> str:
    return f"-0.5 * {one(m)} * (pow((x{q} - ({Z[m][q]})) / (s + 1), 2) + s / (s + 1)) * y{i}"


def by_z2(m: int, q: int, k: int) -> str:
    return f"{two(m, k)} * (-0.5 * ({Z[m][q] - Z[k][q]}) + 0.5 * (2 * x{q} - ({Z[m][q] + Z[k][q]})) / (2 * s + 1))"


def by_a2(q: int, m: int, k: int) -> str:
    return f"{two(m, k)} * (-0.25 * {(Z[m][q] - Z[k][q]) ** 2} - 0.25 * pow((2 * x{q} - ({Z[m][q] + Z[k][q]})) / (2 * s + 1), 2) - s / (2 * s + 1))"


KL = "0.5 * (2 * (s - ln(s)) + x0 * x0 + x1 * x1 - 2)"
PAIR = [(0, 0), (0, 1), (1, 0), (1, 1)]
TRIPLE = [(a, *b) for a in (0, 1) for b in PAIR]


def cells(kind: str, of, at: list[tuple[int, ...]], source: str, digits: int = 4) -> str:
    """One row a cell: its indices and the rounded sum."""
    rows = []
    for ix in at:
        i, j, k = (*ix, 0, 0, 0)[:3]
        rows.append(f"select {i} as i, {j} as j, {k} as k, round(sum({of(*ix)}), {digits}) as v from L")
    return f"with {source} " + " union all ".join(rows)


def sums(gradients: bool = True) -> str:
    """One row of all sums of L."""
    out = ["count(*) as n", "sum(y0 * y0 + y1 * y1) as yy", f"sum(case when s > 0 then {KL.replace('ln(s)', 'ln(greatest(s, 1e-300))')} else 0 end) as kl"]
    out += [f"sum({two(m, k)}) as p{m}{k}" for m, k in PAIR] + [f"sum({one(m)} * y{i}) as c{m}{i}" for m, i in PAIR]
    if gradients:
        for a, b, c in TRIPLE:
            out += [f"sum({by_z1(a, b, c)}) as u{a}{b}{c}", f"sum({by_z2(a, b, c)}) as v{a}{b}{c}", f"sum({by_a1(a, b, c)}) as r{a}{b}{c}", f"sum({by_a2(a, b, c)}) as w{a}{b}{c}"]
    return "select " + ", ".join(out) + " from L"


def _sum(terms) -> str:
    return "(" + " + ".join(f"({t})" for t in terms) + ")"


KIJ = lambda m, k: KI[int(m != k)]
KMM = lambda m, k: K12 if m != k else 1.0


def algebra(source: str, gradients: bool = True) -> str:
    """CTEs t (sums), a (inverse of A), g (products) and d (the bound and its derivatives by the statistics)."""
    ki_p_ki = lambda m, k: _sum(f"{KIJ(m, a)} * p{a}{b} * {KIJ(b, k)}" for a, b in PAIR)
    return f"""with {source}, t as ({sums(gradients)}),
a0 as (select *, (1 + p00) * (1 + p11) - ({K12} + p01) * ({K12} + p01) as det from t),
a as (select *, (1 + p11) / det as a00, -({K12} + p01) / det as a01, -({K12} + p01) / det as a10, (1 + p00) / det as a11 from a0),
g as (select *, {", ".join(f"{_sum(f'a{m}{k} * c{k}{i}' for k in (0, 1))} as e{m}{i}" for m, i in PAIR)} from a),
d as (select *,
  {", ".join(f"{KIJ(m, k)} - a{m}{k} - {ki_p_ki(m, k)} - 0.5 * (e{m}0 * e{k}0 + e{m}1 * e{k}1) as fk{m}{k}" for m, k in PAIR)},
  {", ".join(f"{KIJ(m, k)} - a{m}{k} - 0.5 * (e{m}0 * e{k}0 + e{m}1 * e{k}1) as fp{m}{k}" for m, k in PAIR)},
  -n * ln(2 * pi()) + ln({1 - K12**2!r}) - ln(det) - yy / 2 + {_sum(f"{KIJ(m, k)} * p{m}{k}" for m, k in PAIR)} - n + 0.5 * {_sum(f"c{m}{i} * e{m}{i}" for m, i in PAIR)} - kl as f
  from g)
"""


def adjoint(name: str, digits: int) -> str:
    return algebra(LINES.format(s="0.0"), False) + " union all ".join(f"select {m} as i, {k} as j, round({name}{m}{k}, {digits}) as v from d" for m, k in PAIR)


def grad_z(j: int, q: int) -> str:
    dk = lambda m: -(Z[j][q] - Z[m][q]) * KMM(j, m)
    return _sum([*(f"(fk{j}{m} + fk{m}{j}) * {dk(m)}" for m in (0, 1)), *(f"e{j}{i} * u{j}{q}{i}" for i in (0, 1)), *(f"2 * fp{j}{m} * v{j}{q}{m}" for m in (0, 1))])


def grad_alpha(q: int) -> str:
    dk = lambda m, k: -0.5 * (Z[m][q] - Z[k][q]) ** 2 * KMM(m, k)
    return _sum([*(f"fk{m}{k} * {dk(m, k)}" for m, k in PAIR), *(f"e{m}{i} * r{q}{m}{i}" for m, i in PAIR), *(f"fp{m}{k} * w{q}{m}{k}" for m, k in PAIR)])


GRAD_SF2 = _sum([*(f"fk{m}{k} * {KMM(m, k)}" for m, k in PAIR), "-n", *(f"e{m}{i} * c{m}{i}" for m, i in PAIR), *(f"2 * fp{m}{k} * p{m}{k}" for m, k in PAIR)])
GRAD_BETA = _sum(["n - yy / 2 - n", *(f"({KIJ(m, k)} - a{m}{k}) * p{m}{k}" for m, k in PAIR), *(f"c{m}{i} * e{m}{i}" for m, i in PAIR), *(f"-0.5 * e{m}{i} * p{m}{k} * e{k}{i}" for m, k in PAIR for i in (0, 1))])


def row_gradient(which: str, q: int) -> str:
    """Of a customer's latent, with d's columns joined on."""
    gap = lambda m: f"(x{q} - ({Z[m][q]})) / (s + 1)"
    mid = lambda m, k: f"(2 * x{q} - ({Z[m][q] + Z[k][q]})) / (2 * s + 1)"
    weight = lambda m: f"{one(m)} * {_sum(f'e{m}{i} * y{i}' for i in (0, 1))}"
    if which == "mu":
        return _sum([f"-x{q}", *(f"-{weight(m)} * {gap(m)}" for m in (0, 1)), *(f"-fp{m}{k} * {two(m, k)} * {mid(m, k)}" for m, k in PAIR)])
    return _sum(["-0.5 * (1 - 1 / s)", *(f"{weight(m)} * (0.5 * pow({gap(m)}, 2) - 0.5 / (s + 1))" for m in (0, 1)), *(f"fp{m}{k} * {two(m, k)} * (0.5 * pow({mid(m, k)}, 2) - 1 / (2 * s + 1))" for m, k in PAIR)])
