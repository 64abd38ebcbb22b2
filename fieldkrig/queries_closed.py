"""Queries whose systems are small enough for SQL: two or three neighbours, solved by Cramer's rule or by hand.

They run the operators of the larger queries with fewer neighbours, over all targets, and hold every
weight and variance against an independent formula.
"""

from __future__ import annotations

import math
import uuid
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from .functions.models import Anisotropy, single
from .functions.special import inv_norm_sql, norm_cdf_sql
from .operators import cokriging, fit, indicator, interpolation, kriging, simulate, transform, validate, variogram, vecchia
from .plans.lineage import delete_on_exit, shared_dir
from .queries import _KNN, _T, CUTS, EXPO, FIELD, LAGS, LATTICE, MATHERON, PTS3, REACH, _targets, field, lags_sql, lattice, pairs_sql, pts3, query, rounded
from .queries_models import INDICATOR, LMC, _two
from .sources.points import Grid, points, read_csv, wide_ccdf, wide_simulations, write_csv

LOW, HIGH = transform.Tail("linear", -3.0), transform.Tail("linear", 4.0)
TWO, THREE = kriging.Neighbors(max=2), kriging.Neighbors(max=3)


def cov(h: str) -> str:
    """EXPO at a distance over 0."""
    return f"(0.9*exp(-({h})/0.4))"


def det(rows: list[list[str]]) -> str:
    """A determinant, by its first row."""
    if len(rows) == 1:
        return rows[0][0]
    parts = []
    for j, x in enumerate(rows[0]):
        if x != "0":
            parts.append(f"{'-' if j % 2 else '+'}{x}*({det([r[:j] + r[j + 1 :] for r in rows[1:]])})")
    return "".join(parts) or "0"


def cramer(a: list[list[str]], b: list[str]) -> list[str]:
    """Solutions of a linear system as SQL; entries are column names or numbers."""
    whole = det(a)
    return [f"({det([[b[i] if j == k else x for j, x in enumerate(r)] for i, r in enumerate(a)])})/({whole})" for k in range(len(b))]


def near_sql(k: int, views: str = f"{FIELD}, {_T}", t: str = "tg", w: str = "true") -> str:
    """with ..., nb: a row for each target (tid, tx, ty, tv, ts, tc) and its k neighbours (x1, y1, v1, s1, c1_1, d1 ...)."""
    cols = ", ".join(f"f{i}.x x{i}, f{i}.y y{i}, f{i}.v v{i}, f{i}.s s{i}, f{i}.c1 k{i}, n{i}.d d{i}" for i in range(1, k + 1))
    joins = " ".join(f"join nn n{i} on n{i}.target_id=t.id and n{i}.rank={i} join fld f{i} on f{i}.id=n{i}.id" for i in range(1, k + 1))
    return f"with {views}, {_KNN.format(t=t, w=w)}, nb as (select t.id tid, t.x tx, t.y ty, t.v tv, t.s ts, t.c1 tc, {cols} from {t} t {joins})"


def h(i: int, j: int) -> str:
    return f"sqrt((x{i}-x{j})**2+(y{i}-y{j})**2)"


LOO = {"t": "fld", "w": "t.id<>b.id", "views": FIELD}
# Two neighbours under EXPO: covariances b1, b2 with the target and g between them; the ordinary weights.
_TWO = f", w as (select *, {cov('d1')} b1, {cov('d2')} b2, {cov(h(1, 2))} g from nb), o as (select *, 0.5+(b1-b2)/(2*(1-g)) w1 from w), ok as (select *, b1-w1-g*(1-w1) mu from o)"


def _krige_rows(df, *columns):
    return rounded(df.select("id", *columns), *columns)


# Three neighbours and three drift terms: the weights are the target's barycentric coordinates.
@query(
    "k3_universal_three_neighbors",
    near_sql(3) + f", w as (select *, ((y2-y3)*(tx-x3)+(x3-x2)*(ty-y3))/((y2-y3)*(x1-x3)+(x3-x2)*(y1-y3)) w1, ((y3-y1)*(tx-x3)+(x1-x3)*(ty-y3))/((y2-y3)*(x1-x3)+(x3-x2)*(y1-y3)) w2 from nb), z as (select *, 1-w1-w2 w3 from w) "
    f"select tid id, round(asinh(w1*v1+w2*v2+w3*v3),5) prediction, round(ln(1+greatest(0,1-2*(w1*{cov('d1')}+w2*{cov('d2')}+w3*{cov('d3')})+w1*w1+w2*w2+w3*w3+2*(w1*w2*{cov(h(1, 2))}+w1*w3*{cov(h(1, 3))}+w2*w3*{cov(h(2, 3))}))),5) variance from z",
)
def k3(s, d):
    out = kriging.krige(_targets(s, d), field(s, d), EXPO, method="universal", degree=1, neighbors=THREE)
    return rounded(out.select("id", F.asinh("prediction").alias("prediction"), F.log1p("variance").alias("variance")), "prediction", "variance", digits=5)


_DRIFT_A = [["1", "g12", "g13", "1", "k1"], ["g12", "1", "g23", "1", "k2"], ["g13", "g23", "1", "1", "k3"], ["1", "1", "1", "0", "0"], ["k1", "k2", "k3", "0", "0"]]
_DRIFT_B = ["b1", "b2", "b3", "1", "tc"]


def drift_sql(**near) -> str:
    entries = f"{cov(h(1, 2))} g12, {cov(h(1, 3))} g13, {cov(h(2, 3))} g23, {cov('d1')} b1, {cov('d2')} b2, {cov('d3')} b3"
    weights = ", ".join(f"{x} w{i + 1}" for i, x in enumerate(cramer(_DRIFT_A, _DRIFT_B)))
    return near_sql(3, **near) + f", m as (select *, {entries} from nb), w as (select *, {weights} from m), z as (select *, w1*v1+w2*v2+w3*v3 pred, greatest(0,1-(w1*b1+w2*b2+w3*b3+w4+w5*tc)) var from w)"


@query("k4_external_drift_three_neighbors", drift_sql() + " select tid id, round(asinh(pred),5) prediction, round(ln(1+var),5) variance from z")
def k4(s, d):
    out = kriging.krige(_targets(s, d, "c1"), field(s, d), EXPO, ("c1",), method="drift", neighbors=THREE)
    return rounded(out.select("id", F.asinh("prediction").alias("prediction"), F.log1p("variance").alias("variance")), "prediction", "variance", digits=5)


@query("c2_loo_drift_three_neighbors", drift_sql(**LOO) + " select tid id, round(tv,6) observed, round(asinh(pred),5) predicted, round(ln(1+var),5) variance from z")
def c2(s, d):
    out = kriging.leave_one_out(field(s, d), EXPO, ("c1",), method="drift", neighbors=THREE)
    return rounded(rounded(out.select("id", "observed", F.asinh("predicted").alias("predicted"), F.log1p("variance").alias("variance")), "observed"), "predicted", "variance", digits=5)


def power(x: str) -> str:
    return f"(2.0*pow({x},1.2::double))"


_POWER = cramer([["0", "g12", "g13", "1"], ["g12", "0", "g23", "1"], ["g13", "g23", "0", "1"], ["1", "1", "1", "0"]], ["b1", "b2", "b3", "1"])


# With semivariances in place of covariances the multiplier changes its sign.
@query(
    "k5_power_three_neighbors",
    near_sql(3) + f", m as (select *, {power(h(1, 2))} g12, {power(h(1, 3))} g13, {power(h(2, 3))} g23, {power('d1')} b1, {power('d2')} b2, {power('d3')} b3 from nb), w as (select *, {', '.join(f'{x} w{i + 1}' for i, x in enumerate(_POWER))} from m) "
    "select tid id, round(w1*v1+w2*v2+w3*v3,5) prediction, round(greatest(0,w1*b1+w2*b2+w3*b3+w4),5) variance, round(-w4,5) lagrange from w",
)
def k5(s, d):
    out = kriging.krige(_targets(s, d), field(s, d), single("power:1.2", 2.0, 1.0), neighbors=THREE)
    return rounded(out.select("id", "prediction", "variance", "lagrange"), "prediction", "variance", "lagrange", digits=5)


_NODES = "nodes as (select (iy*20+ix)::bigint id, -0.5+(ix+0.5)*0.05::double x, -0.5+(iy+0.5)*0.05::double y, 0.0 v, 0.0 s, 0.0 c1 from (select unnest(range(20)) ix) cross join (select unnest(range(20)) iy))"
GRID = Grid.from_bbox((-0.5, -0.5), (0.5, 0.5), (20, 20))


@query("k8_grid_two_neighbors", near_sql(2, f"{FIELD}, {_NODES}", "nodes") + _TWO + " select tid node, round(tx,6) x, round(ty,6) y, round(w1*v1+(1-w1)*v2,6) prediction, round(greatest(0,1-(w1*b1+(1-w1)*b2+mu)),6) variance, round(mu,6) lagrange from ok")
def k8(s, d):
    return rounded(kriging.krige_grid(GRID, field(s, d), EXPO, neighbors=TWO), "x", "y", "prediction", "variance", "lagrange")


_OFFS = [((i + 0.5) / 3 - 0.5) * 0.04 for i in range(3)]
_BLOCK = list(product(_OFFS, _OFFS))
_WITHIN = sum(0.9 * math.exp(-math.dist(a, b) / 0.4) for a in _BLOCK for b in _BLOCK) / len(_BLOCK) ** 2


def block_cov(i: int) -> str:
    """Mean covariance of the block around the target with neighbour i."""
    return "(" + "+".join(cov(f"sqrt((tx{dx:+}-x{i})**2+(ty{dy:+}-y{i})**2)") for dx, dy in _BLOCK) + f")/{len(_BLOCK)}"


@query(
    "k9_block_two_neighbors",
    near_sql(2) + _TWO.replace(cov("d1"), block_cov(1)).replace(cov("d2"), block_cov(2)) + f" select tid id, round(w1*v1+(1-w1)*v2,6) prediction, round(greatest(0,{_WITHIN!r}-(w1*b1+(1-w1)*b2+mu)),6) variance from ok",
)
def k9(s, d):
    return _krige_rows(kriging.krige(_targets(s, d), field(s, d), EXPO, neighbors=TWO, block=((0.04, 0.04), (3, 3))), "prediction", "variance")


@query("k14_block_cokriging_one_neighbor", near_sql(1) + f" select tid id, round(v1,6) prediction, round({_WITHIN!r}-2*{block_cov(1)}+1,6) variance from nb")
def k14(s, d):
    return _krige_rows(cokriging.cokrige(_targets(s, d), list(_two(s, d)), LMC, block=((0.04, 0.04), (3, 3)), neighbors=kriging.Neighbors(max=1)), "prediction", "variance")


_A30 = math.radians(30.0)
_U = f"({math.sin(_A30)!r}*{{0}}.x+{math.cos(_A30)!r}*{{0}}.y)"
_W = f"(({math.cos(_A30)!r}*{{0}}.x-{math.sin(_A30)!r}*{{0}}.y)/0.5)"


# The nearest point of each sector in the ellipsoid's frame, then the two nearest of these.
@query(
    "k10_octant_two_neighbors",
    f"with {FIELD}, {_T}, p as (select t.id tid, b.id, b.x, b.y, b.v, sqrt((b.x-t.x)**2+(b.y-t.y)**2) d, ({_U.format('b')}-{_U.format('t')})**2+({_W.format('b')}-{_W.format('t')})**2 d2, ({_U.format('b')}>={_U.format('t')})::int+2*({_W.format('b')}>={_W.format('t')})::int sec from tg t, fld b), "
    "q as (select *, row_number() over (partition by tid, sec order by d2, id) r from p where d2<=0.36), n as (select *, row_number() over (partition by tid order by d2, id) rank from q where r=1), "
    f"m as (select t.id, a.v v1, b.v v2, {cov('a.d')} b1, {cov('b.d')} b2, {cov('sqrt((a.x-b.x)**2+(a.y-b.y)**2)')} g from tg t left join n a on a.tid=t.id and a.rank=1 left join n b on b.tid=t.id and b.rank=2), w as (select *, 0.5+(b1-b2)/(2*(1-g)) w1 from m) "
    "select id, round(case when v2 is null then v1 else w1*v1+(1-w1)*v2 end,6) prediction, round(case when v2 is null then 2-2*b1 else greatest(0,1-(w1*b1+(1-w1)*b2+b1-w1-g*(1-w1))) end,6) variance from w",
)
def k10(s, d):
    near = kriging.Neighbors(max=2, radius=0.6, per_octant=1, ellipsoid=Anisotropy(30.0, 0.5))
    return _krige_rows(kriging.krige(_targets(s, d), field(s, d), EXPO, neighbors=near), "prediction", "variance")


# Ordinary co-kriging with two neighbours each is a regression of Z0 - Z2 on Z1 - Z2 and S1 - S2.
def c11(x: str) -> str:
    return f"(0.9*exp(-({x})/0.4))"


def c12(x: str) -> str:
    return f"(0.8*exp(-({x})/0.4))"


def c22(x: str) -> str:
    return f"(0.95*exp(-({x})/0.4))"


_TWO_BY_TWO = ", q as (select *, (e1*p22-e2*p12)/(p11*p22-p12*p12) w1, (e2*p11-e1*p12)/(p11*p22-p12*p12) u1 from m)"


@query(
    "k13_cokriging_two_neighbors",
    near_sql(2) + f", m as (select *, 2*(1-{c11(h(1, 2))}) p11, 2*(0.85-{c12(h(1, 2))}) p12, 2*(1.07-{c22(h(1, 2))}) p22, {c11('d1')}-{c11('d2')}-{c11(h(1, 2))}+1 e1, {c12('d1')}-{c12('d2')}-{c12(h(1, 2))}+0.85 e2, 2*(1-{c11('d2')}) e0 from nb){_TWO_BY_TWO} "
    "select tid id, round(v2+w1*(v1-v2)+u1*(s1-s2),6) prediction, round(greatest(0,e0-w1*e1-u1*e2),6) variance from q",
)
def k13(s, d):
    return _krige_rows(cokriging.cokrige(_targets(s, d), list(_two(s, d)), LMC, neighbors=TWO), "prediction", "variance")


# Left out: the own primary, not the own secondary, which is the nearest of its kind.
@query(
    "c5_loo_cokriging_two_neighbors",
    near_sql(2, **LOO) + f", m as (select *, 2*(1-{c11(h(1, 2))}) p11, {c12('d1')}-0.85-{c12('d2')}+{c12(h(1, 2))} p12, 2*(1.07-{c22('d1')}) p22, {c11('d1')}-{c11('d2')}-{c11(h(1, 2))}+1 e1, 0.85-{c12('d1')}-{c12('d2')}+{c12(h(1, 2))} e2, 2*(1-{c11('d2')}) e0 from nb){_TWO_BY_TWO} "
    "select tid id, round(tv,6) observed, round(v2+w1*(v1-v2)+u1*(ts-s1),6) predicted, round(greatest(0,e0-w1*e1-u1*e2),6) variance from q",
)
def c5_cok(s, d):
    return rounded(cokriging.leave_one_out_cokriging(list(_two(s, d)), LMC, neighbors=TWO), "observed", "predicted", "variance")


SECOND = single("spherical", 0.8, 0.6, 0.2)
_THREE_W = cramer([["1", "g", "q1"], ["g", "1", "q2"], ["q1", "q2", "1"]], ["b1", "b2", "rho"])
_STATS = "st as (select corr(v,s) rho, stddev_pop(v) sv, stddev_pop(s) ss, avg(v) mv, avg(s) ms from fld)"


def collocated_sql(across, out: str, **near) -> str:
    """across: the correlogram between the variables, without rho."""
    base = near_sql(2, **near)
    entries = f"{cov('d1')} b1, {cov('d2')} b2, {cov(h(1, 2))} g, rho*{across('d1')} q1, rho*{across('d2')} q2"
    weights = ", ".join(f"{x} w{i + 1}" for i, x in enumerate(_THREE_W))
    return base + f", {_STATS}, m as (select *, {entries} from nb, st), w as (select *, {weights} from m), z as (select *, mv+sv*(w1*(v1-mv)/sv+w2*(v2-mv)/sv+w3*(ts-ms)/ss) pred, greatest(0,sv*sv*(1-(w1*b1+w2*b2+w3*rho))) var from w) {out}"


def _spherical(x: str) -> str:
    return f"(case when {x}<0.6 then 0.8*(1-1.5*({x}/0.6)+0.5*({x}/0.6)*({x}/0.6)*({x}/0.6)) else 0 end)"


_COL = "select tid id, round(pred,6) prediction, round(var,6) variance from z"


@query("k15_collocated_mm1_two_neighbors", collocated_sql(cov, _COL))
def k15a(s, d):
    return _krige_rows(cokriging.collocated_cokrige(_targets(s, d, "secondary"), field(s, d), EXPO, neighbors=TWO), "prediction", "variance")


@query("k15_collocated_mm2_two_neighbors", collocated_sql(_spherical, _COL))
def k15b(s, d):
    return _krige_rows(cokriging.collocated_cokrige(_targets(s, d, "secondary"), field(s, d), EXPO, markov="mm2", secondary_model=SECOND, neighbors=TWO), "prediction", "variance")


@query("c5_loo_collocated_two_neighbors", collocated_sql(cov, "select tid id, round(tv,6) observed, round(pred,6) predicted, round(var,6) variance from z", **LOO))
def c5_col(s, d):
    return rounded(cokriging.leave_one_out_collocated(field(s, d), EXPO, neighbors=TWO).select("id", "observed", "predicted", "variance"), "observed", "predicted", "variance")


# Indicators: INDICATOR has sill 0.22, of which 0.02 is the nugget.
def icov(x: str) -> str:
    return f"(0.2*exp(-({x})/0.4))"


_C0 = 0.22 * (1 + 1e-9)


def _clip(x: str) -> str:
    return f"greatest(0.0,least(1.0,{x}))"


_ORDERED = "f as (select *, (r1+least(r1,r2,r3))/2 f1, (greatest(r1,r2)+least(r2,r3))/2 f2, (greatest(r1,r2,r3)+r3)/2 f3 from r)"


def ik_sql(out: str, **near) -> str:
    coded = ", ".join(f"{_clip(f'w1*(v1<={c})::int+(1-w1)*(v2<={c})::int')} r{i + 1}" for i, c in enumerate(CUTS))
    return near_sql(2, **near) + f", w as (select *, 0.5+({icov('d1')}-{icov('d2')})/(2*({_C0!r}-{icov(h(1, 2))})) w1 from nb), r as (select *, {coded} from w), {_ORDERED} {out}"


def _three(df, *columns):
    return rounded(df.select("id", *columns, *[F.get("ccdf", k).alias(f"f{k + 1}") for k in range(3)]), *columns, "f1", "f2", "f3")


@query("k17_indicator_two_neighbors", ik_sql("select tid id, round(f1,6) f1, round(f2,6) f2, round(f3,6) f3 from f"))
def k17(s, d):
    return _three(indicator.indicator_krige(_targets(s, d), field(s, d), list(CUTS), [INDICATOR], LOW, HIGH, neighbors=TWO))


# Moments: a piece of a ccdf from a to b is uniform, and so are linear tails.
_EDGES = [-3.0, *CUTS, 4.0]
_MASS = ["f1", "(f2-f1)", "(f3-f2)", "(1-f3)"]
_FIRST = "+".join(f"{m}*{(a + b) / 2!r}" for m, a, b in zip(_MASS, _EDGES, _EDGES[1:]))
_SECOND = "+".join(f"{m}*{(a * a + a * b + b * b) / 3!r}" for m, a, b in zip(_MASS, _EDGES, _EDGES[1:]))


@query("k19_indicator_moments", ik_sql(f"select tid id, round({_FIRST},6) e_type, round(greatest(0,({_SECOND})-({_FIRST})**2),6) cond_var from f"))
def k19(s, d):
    return _krige_rows(indicator.indicator_krige(_targets(s, d), field(s, d), list(CUTS), [INDICATOR], LOW, HIGH, neighbors=TWO), "e_type", "cond_var")


@query("c5_loo_indicator_two_neighbors", ik_sql("select tid id, round(tv,6) observed, round(f1,6) f1, round(f2,6) f2, round(f3,6) f3 from f", **LOO))
def c5_ik(s, d):
    f = field(s, d)
    out = indicator.indicator_krige(f, f, list(CUTS), [INDICATOR], LOW, HIGH, neighbors=TWO, exclude_self=True)
    return _three(out.join(f.select("id", F.col("value").alias("observed")), "id"), "observed")


def _quantile_sql(q: str) -> str:
    edges, f = _EDGES, ["0.0", "f1", "f2", "f3", "1.0"]
    cases = " ".join(f"when {q}<={f[k]} then case when {f[k]}>{f[k - 1]} then {edges[k - 1]!r}+({q}-{f[k - 1]})/({f[k]}-{f[k - 1]})*{edges[k] - edges[k - 1]!r} else {edges[k]!r} end" for k in range(1, 5))
    return f"(case {cases} else {edges[-1]!r} end)"


@query("c9_accuracy_plot_ccdf_two_neighbors", ik_sql(f"select p::double p, round(avg((tv>={_quantile_sql('((1-p)/2)')} and tv<={_quantile_sql('((1+p)/2)')})::int),6) observed_p from f cross join (select unnest([0.2::double,0.5,0.8]) p) group by 1", **LOO))
def c9(s, d):
    f = field(s, d)
    out = indicator.indicator_krige(f, f, list(CUTS), [INDICATOR], LOW, HIGH, neighbors=TWO, exclude_self=True)
    return rounded(validate.accuracy_plot_ccdf(out.join(f.select("id", F.col("value").alias("observed")), "id"), list(CUTS), [0.2, 0.5, 0.8], -3.0, 4.0), "observed_p")


# Soft indicators: a logistic curve of the secondary; one soft datum at each target.
def soft_sql(c: float, s: str) -> str:
    return f"(1/(1+exp(3*({s}-({c})))))"


_SOFT_W = cramer([[repr(_C0), "g", "q1"], ["g", repr(_C0), "q2"], ["q1", "q2", "vs"]], ["b1", "b2", "b3"])


def soft_query() -> str:
    cal = ", ".join(f"corr((v<={c})::int,{soft_sql(c, 's')}) rho{k}, stddev_pop({soft_sql(c, 's')}) sd{k}, avg({soft_sql(c, 's')}) m{k}, avg((v<={c})::int) p{k}" for k, c in enumerate(CUTS, 1))
    sql = near_sql(2) + f", cal as (select {cal} from fld), g0 as (select *, {icov('d1')} b1, {icov('d2')} b2, {icov(h(1, 2))} g from nb, cal)"
    last = "g0"
    for k, c in enumerate(CUTS, 1):
        root = math.sqrt(0.22)
        sql += f", e{k} as (select *, rho{k}*sd{k}/{root!r}*b1 q1, rho{k}*sd{k}/{root!r}*b2 q2, sd{k}*sd{k}+{0.22e-9!r} vs, rho{k}*sd{k}*{root!r} b3 from {last}), "
        sql += f"w{k} as (select *, {', '.join(f'{x} z{i + 1}' for i, x in enumerate(_SOFT_W))} from e{k}), "
        estimate = f"p{k}+z1*((v1<={c})::int-p{k})+z2*((v2<={c})::int-p{k})+z3*({soft_sql(c, 'ts')}-m{k})"
        sql += f"g{k} as (select * exclude (q1,q2,vs,b3,z1,z2,z3), {_clip(estimate)} r{k} from w{k})"
        last = f"g{k}"
    return sql + f", r as (select * from {last}), {_ORDERED} select tid id, round(f1,6) f1, round(f2,6) f2, round(f3,6) f3 from f"


def _soft(s, d):
    """(targets with soft columns, data, calibration)."""
    f = field(s, d)
    names = [f"p{k}" for k in range(len(CUTS))]
    columns = [(1 / (1 + F.exp(3 * (F.col("secondary") - c)))).alias(n) for n, c in zip(names, CUTS)]
    return _targets(s, d, *columns), f, indicator.calibrate_markov_bayes(f.select("value", *columns), list(CUTS), names), tuple(names)


@query("k20_soft_indicator_two_neighbors", soft_query())
def k20(s, d):
    targets, f, calibration, names = _soft(s, d)
    return _three(indicator.indicator_krige(targets, f, list(CUTS), [INDICATOR], LOW, HIGH, False, TWO, names, calibration))


_TREND = "(regr_intercept(v,c1) over ()+regr_slope(v,c1) over ()*c1)"


@query(
    "k21_regression_two_neighbors",
    near_sql(2, f"{FIELD.replace('fld as', 'raw as')}, fld as (select * exclude v, v-{_TREND} v, {_TREND} trend from raw), {_T.replace('c1 from', 'c1, trend from')}") + _TWO + " select tid id, round(w1*v1+(1-w1)*v2+tg.trend,6) prediction, round(greatest(0,1-(w1*b1+(1-w1)*b2+mu)),6) variance from ok join tg on tg.id=tid",
)
def k21(s, d):
    f = field(s, d)
    trend = transform.trend_col(transform.ols(f, [F.col("c1")]), [F.col("c1")])
    return _krige_rows(kriging.regression_kriging(_targets(s, d, "c1").withColumn("trend", trend), f.withColumn("trend", trend), EXPO, neighbors=TWO), "prediction", "variance")


_OKCV = " select tid id, round(tv,6) observed, round(w1*v1+(1-w1)*v2,6) predicted, round(greatest(0,1-(w1*b1+(1-w1)*b2+mu)),6) variance from ok"
_FOLDS = "fld as (select raw.*, greatest(0,least(2,floor((x-ax)/((bx-ax)/3))))+3*greatest(0,least(2,floor((y-ay)/((dy-ay)/3)))) fold from raw, (select min(x) ax, max(x) bx, min(y) ay, max(y) dy from raw))"


@query("c4_block_cv_two_neighbors", near_sql(2, f"{FIELD.replace('fld as', 'raw as')}, {_FOLDS}", "fld", "t.fold<>b.fold") + _TWO + _OKCV)
def c4(s, d):
    return rounded(kriging.leave_one_out(kriging.block_fold(field(s, d), (3, 3)), EXPO, fold="fold", neighbors=TWO), "observed", "predicted", "variance")


@query(
    "c5_loo_lognormal_two_neighbors",
    near_sql(2, **(LOO | {"views": f"{FIELD.replace('fld as', 'raw as')}, fld as (select * exclude v, ln(v+3) v from raw)"})) + _TWO + ", e as (select *, greatest(0,1-(w1*b1+(1-w1)*b2+mu)) var from ok), p as (select *, exp(w1*v1+(1-w1)*v2+var/2-mu) pred from e) select tid id, round(exp(tv),6) observed, round(pred,6) predicted, round(pred*pred*(exp(var)-1),5) variance from p",
)
def c5_log(s, d):
    out = kriging.leave_one_out_lognormal(field(s, d).withColumn("value", F.col("value") + 3), EXPO, neighbors=TWO)
    return rounded(rounded(out, "observed", "predicted"), "variance", digits=5)


_CV = f"with {FIELD}, {_KNN.format(t='fld', w='t.id<>b.id')}, nb as (select t.id tid, t.v tv, f1.x x1, f1.y y1, f1.v v1, n1.d d1, f2.x x2, f2.y y2, f2.v v2, n2.d d2 from fld t join nn n1 on n1.target_id=t.id and n1.rank=1 join fld f1 on f1.id=n1.id join nn n2 on n2.target_id=t.id and n2.rank=2 join fld f2 on f2.id=n2.id){_TWO}"
_ERRORS = "mm as (select avg(v) m from fld)"


@query(
    "c11_compare_methods_two_neighbors",
    _CV + f", {_ERRORS}, cv as (select 'ok' k, tv o, w1*v1+(1-w1)*v2 p from ok union all select 'idw', f.v, q.p from fld f join (select target_id, sum(v/(d*d))/sum(1/(d*d)) p from nn where rank<=12 group by 1) q on q.target_id=f.id union all select 'knn', f.v, q.p from fld f join (select target_id, avg(v) p from nn where rank<=8 group by 1) q on q.target_id=f.id union all select 'nn', tv, v1 from nb) "
    "select k as \"method\", round(avg(p-o),6) me, round(avg(abs(p-o)),6) mae, round(sqrt(avg((p-o)**2)),6) rmse, round(100*(1-sum((p-o)**2)/sum((o-m)**2)),6) vecv, round(100*(1-sum(abs(p-o))/sum(abs(o-m))),6) e1 from cv, mm group by 1",
)
def c11_compare(s, d):
    f = field(s, d)
    frames = {"ok": kriging.leave_one_out(f, EXPO, neighbors=TWO), "idw": interpolation.idw_cross_validate(f, 2.0, 12), "knn": interpolation.knn_cross_validate(f, 8), "nn": interpolation.knn_cross_validate(f, 1)}
    out = None
    for name, cv in frames.items():
        row = validate.metrics(cv).select(F.lit(name).alias("method"), "me", "mae", "rmse", "vecv", "e1")
        out = row if out is None else out.unionByName(row)
    return rounded(out, "me", "mae", "rmse", "vecv", "e1")


@query("c12_tune_kriging_one_and_two", _CV + f", {_ERRORS} select param::double param, round(100*(1-sum((p-o)**2)/sum((o-m)**2)),6) vecv from (select 1 param, tv o, v1 p from nb union all select 2, tv, w1*v1+(1-w1)*v2 from ok), mm group by 1")
def c12(s, d):
    f, out = field(s, d), None
    for k in (1, 2):
        row = validate.metrics(kriging.leave_one_out(f, EXPO, neighbors=kriging.Neighbors(max=k))).select(F.lit(float(k)).alias("param"), "vecv")
        out = row if out is None else out.unionByName(row)
    return rounded(out, "vecv")


@query("f5_usable_bins_rounded", f"select round(h,6) h, round(gamma,6) gamma, n_pairs from ({pairs_sql('fld', REACH, FIELD) + lags_sql(MATHERON)}) where n_pairs>0 and h>0 and gamma is not null")
def f5(s, d):
    hs, g, n = fit.usable(variogram.experimental_variogram(field(s, d), LAGS, REACH))
    return rounded(s.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(hs, g, n)], "h double, gamma double, n_pairs long"), "h", "gamma")


@query("m5_matern_half_integers", "with p as (select vec_id::bigint id, sqrt(embedding[1]::double**2+embedding[2]::double**2) h from embeddings) select id, round(1-(1+sqrt(3)*h/0.3)*exp(-sqrt(3)*h/0.3),6) m15, round(1-(1+sqrt(5)*h/0.3+5*h*h/0.27)*exp(-sqrt(5)*h/0.3),6) m25, round(1-exp(-h/0.3),6) m05 from p")
def m5(s, d):
    """The kernel's form, in numpy."""

    def run(batches):
        for b in batches:
            yield b[["id"]].assign(**{name: single(f"matern:{nu}", 1.0, 0.3).gamma_h(b["h"].to_numpy()) for name, nu in (("m15", 1.5), ("m25", 2.5), ("m05", 0.5))})

    rows = field(s, d).select("id", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("h"))
    return rounded(rows.mapInPandas(run, "id long, m15 double, m25 double, m05 double"), "m15", "m25", "m05")


# Realizations that are known in advance: the field plus waves.
_SIMS = f"{FIELD}, sm as (select r, id, x, y, v+0.1*r*sin(9*x) v from fld cross join (select unnest([0,1,2]) r))"


@query(
    "v14_realization_qc_fixed",
    f"with {_SIMS}, pr as (select a.r, sqrt((b.x-a.x)**2+(b.y-a.y)**2) d, b.v-a.v dz from sm a join sm b on a.r=b.r and a.id<b.id), e as (select r, least(ceil(d/0.03)::int-1,9) lag, avg(d) h, avg(0.5*dz*dz) g from pr where d>0 and d<=0.3 group by 1,2) "
    "select lag::int lag, round(avg(h),6) h, round(avg(g),6) mean_gamma, round(stddev_samp(g),6) std_gamma, count(*)::bigint n_realizations, round(0.1+0.9*(1-exp(-avg(h)/0.4)),6) model_gamma from e group by 1",
)
def v14(s, d):
    f = field(s, d).select("id", "x", "y", "value", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("realization"))
    sims = f.withColumn("value", F.col("value") + 0.1 * F.col("realization") * F.sin(9 * F.col("x")))
    return rounded(variogram.realization_qc(sims, EXPO, LAGS, REACH), "h", "mean_gamma", "std_gamma", "model_gamma")


# Normal scores as plans: values between the knots, ends outside; and back with tails.
_KNOTS = f"ns as (select v, (row_number() over (order by v,id)-0.5)/count(*) over () p from fld), kn as (select v kv, avg({inv_norm_sql('p')}) ky from ns group by 1)"


@query(
    "t4_forward_scores",
    f"with {FIELD}, {_KNOTS}, a as (select fld.id, fld.s, kv x0, ky y0 from fld asof left join kn on fld.s>=kn.kv), b as (select a.*, kv x1, ky y1 from a asof left join kn on a.s<=kn.kv) "
    "select id, round(case when x0 is null then y1 when x1 is null then y0 when x1>x0 then y0+(y1-y0)*(s-x0)/(x1-x0) else y0 end,6) score from b",
)
def t4f(s, d):
    f = field(s, d)
    return rounded(transform.forward_scores(f.select("id", "secondary"), transform.normal_scores(f), "secondary").select("id", "score"), "score")


_P0, _P1 = norm_cdf_sql("x0"), norm_cdf_sql("x1")


@query(
    "t4_back_scores",
    f"with {FIELD}, {_KNOTS}, q as (select id, 40*c1 y from fld), a as (select q.*, ky x0, kv y0 from q asof left join kn on q.y>=kn.ky), b as (select a.*, ky x1, kv y1 from a asof left join kn on a.y<=kn.ky) "
    f"select id, round(case when x0 is null then -3+(y1+3)*({norm_cdf_sql('y')}/{_P1}) when x1 is null then 4-(4-y0)*sqrt((1-{norm_cdf_sql('y')})/(1-{_P0})) when x1>x0 then y0+(y1-y0)*(y-x0)/(x1-x0) else y0 end,5) \"value\" from b",
)
def t4b(s, d):
    f = field(s, d)
    rows = f.select("id", (40 * F.col("c1")).alias("score"))
    return rounded(transform.back_scores(rows, transform.normal_scores(f), LOW, transform.Tail("power", 4.0, 2.0)).select("id", "value"), "value", digits=5)


# Predecessors in the order of ids: each point's nearest two of those before it; with one, the likelihood in closed form.
_BEFORE = f"with {FIELD}, o as (select *, row_number() over (order by id)-1 pos from fld), pd as (select a.pos, b.pos bpos, a.v av, b.v bv, sqrt((a.x-b.x)**2+(a.y-b.y)**2) d, row_number() over (partition by a.pos order by (a.x-b.x)**2+(a.y-b.y)**2, b.pos) r from o a join o b on b.pos<a.pos)"


def _in_order(s, d):
    p = kriging.collect_points(field(s, d).select("id", "x", "y", "value"))
    return p["xyz"], p["value"], np.arange(len(p["id"]))


PREDECESSORS_SQL = _BEFORE + " select pos::bigint pos, bpos::bigint neighbor from pd where r<=2"


@query(
    "x3_vecchia_loglik_one_neighbor",
    _BEFORE + f", m as (select avg(v) m from fld), t as (select o.v-m z, bv-m zb, coalesce({cov('d')},0) c from o left join pd on pd.pos=o.pos and r=1, m), e as (select 1-c*c var, z-c*coalesce(zb,0) e from t) select round(sum(-0.5*(ln(2*pi()*var)+e*e/var)),4) loglik from e",
)
def x3(s, d):
    x, z, order = _in_order(s, d)
    return rounded(vecchia.loglik_frame(s, x, z, EXPO, vecchia.make_plan(x, 1, order=order, spark=s)), "loglik", digits=4)


# Sources and sinks: out to files in the shared folder, and back.
def _csv_folder(s) -> str:
    path = f"{shared_dir(s)}/points-{uuid.uuid4().hex}"
    delete_on_exit(s, path)
    return path


@query("s1_csv_round_trip", f"with {FIELD} select round(x,6) x, round(y,6) y, round(v,6) as \"value\", round(c1,6) c1 from fld")
def s1(s, d):
    path = _csv_folder(s)
    write_csv(field(s, d).select("x", "y", "value", "c1"), path)
    back, _ = read_csv(s, path, "x", "y", "value", extras=("c1",))
    return rounded(back.select("x", "y", "value", "c1"), "x", "y", "value", "c1")


@query("s3_csv_three_dimensions", f"with {PTS3} select round(x,6) x, round(y,6) y, round(z,6) z, round(v,6) as \"value\" from pts3 where v>0")
def s3(s, d):
    """Rows without a value are left out: here every second or so, whose value is written as text."""
    path = _csv_folder(s)
    write_csv(pts3(s, d).select("x", "y", "z", F.when(F.col("value") > 0, F.col("value").cast("string")).otherwise("none").alias("v")), path)
    back, _ = read_csv(s, path, "x", "y", "v", "z")
    return rounded(back.select("x", "y", "z", "value"), "x", "y", "z", "value")


@query("s9_wide_simulations", f"with {_SIMS}, p as (select id, x, y, c1, r, v+0.1*r*sin(9*x) w from fld cross join (select unnest([0,1,2]) r)) select id node, round(any_value(x),6) x, round(any_value(y),6) y, round(any_value(c1),6) z, round(sum(case when r=0 then w end),6) sim1, round(sum(case when r=1 then w end),6) sim2, round(sum(case when r=2 then w end),6) sim3 from p group by 1")
def s9(s, d):
    f = field(s, d).select(F.col("id").alias("node"), "x", "y", F.col("c1").alias("z"), "value", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("realization"))
    sims = f.withColumn("value", F.col("value") + 0.1 * F.col("realization") * F.sin(9 * F.col("x")))
    return rounded(wide_simulations(sims, 3), "x", "y", "z", "sim1", "sim2", "sim3")


@query("s10_wide_ccdf", ik_sql(f"select round(tx,6) x, round(ty,6) y, round(f1,6) \"F_1\", round(f2,6) \"F_2\", round(f3,6) \"F_3\", round({_FIRST},6) e_type, round(greatest(0,({_SECOND})-({_FIRST})**2),6) cond_var from f"))
def s10(s, d):
    out = indicator.indicator_krige(_targets(s, d), field(s, d), list(CUTS), [INDICATOR], LOW, HIGH, neighbors=TWO)
    return rounded(wide_ccdf(out, 3), "x", "y", "F_1", "F_2", "F_3", "e_type", "cond_var")


@query("f6_projection", f"with {LATTICE} select id, x::double x, y::double y, round(v,6) as \"value\" from lat")
def f6(s, d):
    return rounded(points(lattice(s, d).withColumnRenamed("value", "price"), "x", "y", "price", id="id"), "value")


# Of the second table the points of one category have moved.
_MISSED = "(select count(*)=0 from fld a full join {0} b on a.id=b.id where not coalesce(a.x=b.x and a.y=b.y,false))"


@query("j8_collocation_check", f"with {FIELD}, mv as (select id, x + case when category=3 then 1 else 0 end x, y from fld), le as (select id, x, y from fld where category<>3) select {_MISSED.format('fld')} same, {_MISSED.format('mv')} moved, {_MISSED.format('le')} fewer")
def j8(s, d):
    f = field(s, d).select("id", "x", "y", "category")
    moved = f.withColumn("x", F.col("x") + F.when(F.col("category") == 3, 1).otherwise(0))
    rows = [(variogram.check_collocated(f, f), variogram.check_collocated(f, moved), variogram.check_collocated(f, f.filter("category <> 3")))]
    return s.createDataFrame(rows, "same boolean, moved boolean, fewer boolean")


@query("x9_vecchia_reml_covariates")
def x9(s, d):
    p = kriging.collect_points(field(s, d).select("id", "x", "y", "value", "c1"), ("c1",))
    e = vecchia.reml(p["xyz"], p["value"], "exponential", m=8, covariates=p["c1"], spark=s)
    t = e.model.structures[0]
    return s.createDataFrame([(float(e.model.nugget), float(t.sill), float(t.range), float(e.loglik))], "nugget double, sill double, range double, loglik double")


@query("t6_ccdf_draws", f"with {FIELD}, q as (select id, (id%97+0.5)/97.0::double u, 0.2+0.1*sin(x) f1, 0.5+0.1*cos(y) f2, 0.8+0.1*sin(y) f3 from fld) select id, round({_quantile_sql('u')},6) draw from q")
def t6(s, d):
    f = field(s, d).select("id", ((F.col("id") % 97 + 0.5) / 97.0).alias("u"), F.array(0.2 + 0.1 * F.sin("x"), 0.5 + 0.1 * F.cos("y"), 0.8 + 0.1 * F.sin("y")).alias("ccdf"))
    return rounded(f.select("id", validate.ccdf_quantile(F.col("ccdf"), F.col("u"), list(CUTS), LOW.bound, HIGH.bound).alias("draw")), "draw")
