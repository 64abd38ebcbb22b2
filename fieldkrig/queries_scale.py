"""Queries of the plans for data of any number, with their bounds so low that these tables take them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .functions.models import Anisotropy, single, unit_gamma_col
from .functions.special import inv_norm_sql
from .operators import cokriging, indicator, kriging, transform
from .plans.pairs import knn_join
from .plans.places import with_place
from .plans.predecessors import predecessor_join
from .queries import EXPO, FIELD, ORACLES, _targets, field, query, rounded
from .queries_closed import CUTS, HIGH, INDICATOR, LMC, LOW, PREDECESSORS_SQL, _krige_rows, _three, _two

#: Data that may be broadcast here: fewer than any table has.
FEW = 100

# Points in clusters of three densities, and outliers.
CLUSTERED = """cl as (select vec_id::bigint id, embedding[1]::double * case when label < 4 then 0.01 when label < 9 then 1 else 60 end x,
  embedding[2]::double * case when label < 4 then 0.01 when label < 9 then 1 else 60 end y from embeddings)"""


def clustered(s, d):
    width = F.when(F.col("category") < 4, 0.01).when(F.col("category") < 9, 1.0).otherwise(60.0)
    return field(s, d).select("id", (F.col("x") * width).alias("x"), (F.col("y") * width).alias("y"))


def _cl_sql(u: str, w: str, per: int | None, k: int, reach: str = "true") -> str:
    """target_id, id, rank, d in a frame of coordinates u and w."""
    d2 = f"(({u.format('b')})-({u.format('a')}))**2+(({w.format('b')})-({w.format('a')}))**2"
    sector = f"(({u.format('b')})>=({u.format('a')}))::int+2*(({w.format('b')})>=({w.format('a')}))::int"
    kept = f"where r<={per}" if per else ""
    return (
        f"with {CLUSTERED}, p as (select a.id target_id, b.id, {d2} d2, {sector} sec from cl a, cl b where a.id<>b.id), q as (select *, row_number() over (partition by target_id, sec order by d2, id) r from p where {reach}), "
        f"n as (select *, row_number() over (partition by target_id order by d2, id)::int rank from q {kept}) select target_id, id, rank, round(sqrt(d2),6) d from n where rank<={k}"
    )


@query("j2_knn_join_clustered", _cl_sql("{0}.x", "{0}.y", None, 6))
def j2(s, d):
    f = clustered(s, d)
    return rounded(knn_join(f, f, 6, exclude_self=True, broadcast_points=10), "d")


@query("j4_octant_join_clustered", _cl_sql("{0}.x", "{0}.y", 2, 6))
def j4(s, d):
    f = clustered(s, d)
    return rounded(knn_join(f, f, 6, exclude_self=True, broadcast_points=10, per_sector=2), "d")


_AZ = math.radians(30.0)
_TURNED = (f"({math.sin(_AZ)!r}*{{0}}.x+{math.cos(_AZ)!r}*{{0}}.y)", f"(({math.cos(_AZ)!r}*{{0}}.x-{math.sin(_AZ)!r}*{{0}}.y)/0.5)")


@query("j5_ellipsoid_join_clustered", _cl_sql(*_TURNED, 2, 6, "d2<=4"))
def j5(s, d):
    f = clustered(s, d)
    return rounded(knn_join(f, f, 6, radius=2.0, exclude_self=True, broadcast_points=10, per_sector=2, matrix=Anisotropy(30.0, 0.5).matrix(2)), "d")


def near(k: int, **options) -> kriging.Neighbors:
    return kriging.Neighbors(max=k, broadcast=FEW, **options)


def tiled(name: str):
    """Registers the form by tiles of a query that has SQL."""
    return query(f"{name}_by_tiles", ORACLES[name])


@tiled("k1_ordinary_kriging")
def k1(s, d):
    return rounded(kriging.krige(_targets(s, d), field(s, d), EXPO, neighbors=near(2)).drop("x", "y"), "prediction", "variance", "lagrange")


@tiled("k3_universal_three_neighbors")
def k3(s, d):
    out = kriging.krige(_targets(s, d), field(s, d), EXPO, method="universal", degree=1, neighbors=near(3))
    return rounded(out.select("id", F.asinh("prediction").alias("prediction"), F.log1p("variance").alias("variance")), "prediction", "variance", digits=5)


@tiled("k4_external_drift_three_neighbors")
def k4(s, d):
    out = kriging.krige(_targets(s, d, "c1"), field(s, d), EXPO, ("c1",), method="drift", neighbors=near(3))
    return rounded(out.select("id", F.asinh("prediction").alias("prediction"), F.log1p("variance").alias("variance")), "prediction", "variance", digits=5)


@tiled("k6_measurement_error")
def k6(s, d):
    f = field(s, d).withColumn("err", F.lit(0.2))
    return rounded(kriging.krige(_targets(s, d), f, EXPO, error="err", method="simple", mean=0.3, neighbors=near(2)).select("id", "prediction", "variance"), "prediction", "variance")


@tiled("k10_octant_two_neighbors")
def k10(s, d):
    return _krige_rows(kriging.krige(_targets(s, d), field(s, d), EXPO, neighbors=near(2, radius=0.6, per_octant=1, ellipsoid=Anisotropy(30.0, 0.5))), "prediction", "variance")


@tiled("k13_cokriging_two_neighbors")
def k13(s, d):
    return _krige_rows(cokriging.cokrige(_targets(s, d), list(_two(s, d)), LMC, neighbors=near(2)), "prediction", "variance")


@tiled("k17_indicator_two_neighbors")
def k17(s, d):
    return _three(indicator.indicator_krige(_targets(s, d), field(s, d), list(CUTS), [INDICATOR], LOW, HIGH, neighbors=near(2)))


@tiled("c1_leave_one_out")
def c1(s, d):
    return rounded(kriging.leave_one_out(field(s, d), EXPO, neighbors=near(2)), "observed", "predicted", "variance")


@query("k11_global_gradients")
def k11(s, d):
    """All data at once by conjugate gradients, whatever their number."""
    from .operators.globalkriging import krige_global

    return krige_global(_targets(s, d), field(s, d), EXPO).select("id", "prediction", "lagrange")


@query("c3_fold_sizes", "with n as (select count(*) n from embeddings) select k::int fold, ((n - k + 4) // 5)::bigint n_points from n cross join (select unnest(range(5)) k)")
def c3(s, d):
    return kriging.shuffled_fold(field(s, d), 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n_points"))


# A column of which half is 0: one value holds half of the rows.
_HALF = "hz as (select id, greatest(s - 0.4, 0.0) v from fld), ns as (select v, (row_number() over (order by v,id)-0.5)/count(*) over () p from hz)"


def _half(s, d):
    return field(s, d).select("id", F.greatest(F.col("secondary") - 0.4, F.lit(0.0)).alias("value"))


@query("t3_normal_scores_half_zero", f"with {FIELD}, {_HALF} select v as \"value\", round(avg({inv_norm_sql('p')}),6) score from ns group by 1")
def t3(s, d):
    return rounded(transform.normal_scores(_half(s, d)), "score")


@query("t4_forward_scores_half_zero", f"with {FIELD}, {_HALF}, kn as (select v, avg({inv_norm_sql('p')}) y from ns group by 1) select hz.id, round(y,6) score from hz join kn using (v)")
def t4(s, d):
    f = _half(s, d)
    return rounded(transform.forward_scores(f, transform.normal_scores(f)).select("id", "score"), "score")


@query("a10_quantile_cutoffs_half_zero", f"with {FIELD}, {_HALF}, r as (select v, row_number() over (order by v)-1 k, count(*) over () n from hz) select q::double q, round(v,6) cutoff from r join (select unnest([0.2,0.5,0.6,0.9]) q) on k=least(floor(q*n),n-1)")
def a10(s, d):
    qs = [0.2, 0.5, 0.6, 0.9]
    return rounded(s.createDataFrame(list(zip(qs, transform.quantile_cutoffs(_half(s, d), qs))), "q double, cutoff double"), "cutoff")


# Matérn models in the plan: closed forms at half-integers, the Bessel function's integral by the trapezoid rule elsewhere.
_S12 = "(sqrt(2.4)*h/0.3)"


@query(
    "m5_matern_column",
    "with p as (select vec_id::bigint id, sqrt(embedding[1]::double**2+embedding[2]::double**2) h from embeddings) "
    "select id, round(1-exp(-h/0.3),6) m05, round(1-(1+sqrt(3)*h/0.3)*exp(-sqrt(3)*h/0.3),6) m15, round(1-(1+sqrt(5)*h/0.3+5*h*h/0.27)*exp(-sqrt(5)*h/0.3),6) m25, "
    f"round(1-pow(2,-0.2)/gamma(1.2)*pow({_S12},1.2)*0.01*(exp(-{_S12})/2+list_sum([exp(-{_S12}*cosh(t*0.01))*cosh(1.2*t*0.01) for t in range(1,1200)])),6) m12 from p",
)
def m5(s, d):
    h = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    forms = {"m05": 0.5, "m15": 1.5, "m25": 2.5, "m12": 1.2}
    return rounded(field(s, d).select("id", *[unit_gamma_col("matern", nu, h, 0.3).alias(name) for name, nu in forms.items()]), *forms)


@query("m5_matern_continuous", "with p as (select vec_id::bigint id, sqrt(embedding[1]::double**2+embedding[2]::double**2) h from embeddings) " f"select id, round(h,6) h, round(1-pow(2,-0.2)/gamma(1.2)*pow({_S12},1.2)*0.01*(exp(-{_S12})/2+list_sum([exp(-{_S12}*cosh(t*0.01))*cosh(1.2*t*0.01) for t in range(1,1200)])),6) gamma from p")
def m5c(s, d):
    h = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return rounded(field(s, d).select("id", h.alias("h"), single("matern:1.2", 1.0, 0.3).gamma_col(h).alias("gamma")), "h", "gamma")


@query("j10_predecessor_join", PREDECESSORS_SQL)
def j10(s, d):
    placed, n = with_place(field(s, d).select("id", "x", "y"), "id", "pos")
    return predecessor_join(placed, 2, n).select("pos", "neighbor")


@query("c12_tune_kriging_one_and_two_together", ORACLES["c12_tune_kriging_one_and_two"])
def c12(s, d):
    from .api import tune_kriging_neighbors

    return rounded(tune_kriging_neighbors(field(s, d), EXPO, (1, 2)), "vecv")
