"""Registered queries over the driver tables, each with its SQL where SQL can say it.

Point sets are derived from ``embeddings`` (coordinates and values from components)
and ``part`` (a lattice); see views().
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.models import Anisotropy, Structure, VariogramModel, single, unit_gamma_col
from .functions.special import DOWD_SQL, inv_norm_cdf_col, inv_norm_sql, norm_cdf_col, norm_cdf_sql
from .operators import interpolation, kriging, transform, validate, variogram
from .plans.pairs import cross_pairs, knn_join, pair_join
from .sources.points import Grid, bbox, duplicates, sample_raster

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _e(i: int):
    return F.get("embedding", i).cast("double")


def pts2(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), _e(0).alias("x"), _e(1).alias("y"), _e(2).alias("value"))


def pts3(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), _e(0).alias("x"), _e(1).alias("y"), _e(3).alias("z"), _e(4).alias("value"))


def field(spark: SparkSession, d: str) -> DataFrame:
    value = F.sin(8 * _e(0)) + F.cos(6 * _e(1)) + 0.1 * _e(2)
    return spark.read.parquet(f"{d}/embeddings.parquet").select(
        F.col("vec_id").cast("long").alias("id"), _e(0).alias("x"), _e(1).alias("y"), value.alias("value"), (value + 0.3 * _e(3)).alias("secondary"), _e(5).alias("c1"), _e(6).alias("c2"), F.col("label").cast("int").alias("category")
    )


def lattice(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("long")
    return spark.read.parquet(f"{d}/part.parquet").select(key.alias("id"), (key % 50).cast("double").alias("x"), F.floor(key / 50).cast("double").alias("y"), F.col("p_retailprice").cast("double").alias("value"))


PTS2 = "pts2 as (select vec_id::bigint id, embedding[1]::double x, embedding[2]::double y, embedding[3]::double v from embeddings)"
PTS3 = "pts3 as (select vec_id::bigint id, embedding[1]::double x, embedding[2]::double y, embedding[4]::double z, embedding[5]::double v from embeddings)"
FIELD = """fld as (select vec_id::bigint id, embedding[1]::double x, embedding[2]::double y,
  sin(8*embedding[1]::double)+cos(6*embedding[2]::double)+0.1*embedding[3]::double v,
  sin(8*embedding[1]::double)+cos(6*embedding[2]::double)+0.1*embedding[3]::double+0.3*embedding[4]::double s,
  embedding[6]::double c1, embedding[7]::double c2, label::int category from embeddings)"""
LATTICE = "lat as (select p_partkey::bigint id, (p_partkey%50)::double x, (p_partkey//50)::double y, p_retailprice::double v from part)"
LAGS, REACH = 10, 0.3


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def pairs_sql(src: str, reach: float, view: str, dim: int = 2, where: str = "true", extra: str = "") -> str:
    d2 = "+".join(f"(b.{c}-a.{c})*(b.{c}-a.{c})" for c in "xyz"[:dim])
    diff = ", ".join(f"b.{c}-a.{c} {n}" for c, n in zip("xyz"[:dim], ("dx", "dy", "d_z")))
    return f"with {view}, pr as (select * from (select a.id i, b.id j, sqrt({d2}) d, {diff}, b.v-a.v dz{extra} from {src} a, {src} b where a.id<b.id) where d>0 and d<={reach} and {where})"


def lags_sql(gamma: str, reach: float = REACH, n: int = LAGS) -> str:
    w = reach / n
    return f""", bn as (select least(ceil(d/{w!r})::int-1,{n - 1}) lag, avg(d) h, {gamma} g, count(*) n from pr group by 1)
    select l.lag::int lag, round(coalesce(h,(l.lag+0.5)*{w!r}),6) h, round(g,6) gamma, coalesce(n,0)::bigint n_pairs from (select unnest(range({n})) lag) l left join bn on bn.lag=l.lag"""


MATHERON = "avg(0.5*dz*dz)"


@query("v1_matheron", pairs_sql("fld", REACH, FIELD) + lags_sql(MATHERON))
def v1(s, d):
    return rounded(variogram.experimental_variogram(field(s, d), LAGS, REACH), "h", "gamma")


@query("v1_matheron_3d", pairs_sql("pts3", 0.4, PTS3, 3) + lags_sql(MATHERON, 0.4, 8))
def v1_3d(s, d):
    return rounded(variogram.experimental_variogram(pts3(s, d), 8, 0.4), "h", "gamma")


_AZ = math.radians(30.0)
_CONE = f"abs(dx*{math.sin(_AZ)!r}+dy*{math.cos(_AZ)!r})>=d*{math.cos(math.radians(22.5))!r}"


@query("v2_directional", pairs_sql("fld", REACH, FIELD, where=_CONE) + lags_sql(MATHERON))
def v2(s, d):
    return rounded(variogram.experimental_variogram(field(s, d), LAGS, REACH, azimuth=30.0, tolerance=22.5), "h", "gamma")


_DIP = math.radians(20.0)
_CONE3 = f"abs(dx*{math.cos(_DIP) * math.sin(_AZ)!r}+dy*{math.cos(_DIP) * math.cos(_AZ)!r}+d_z*{math.sin(_DIP)!r})>=d*{math.cos(math.radians(35.0))!r}"


@query("v2_directional_3d", pairs_sql("pts3", 0.4, PTS3, 3, where=_CONE3) + lags_sql(MATHERON, 0.4, 8))
def v2_3d(s, d):
    return rounded(variogram.experimental_variogram(pts3(s, d), 8, 0.4, azimuth=30.0, tolerance=35.0, dip=20.0), "h", "gamma")


@query("v3_default_max_dist", f"with {FIELD} select round(sqrt((max(x)-min(x))**2+(max(y)-min(y))**2)/3,6) max_dist from fld")
def v3(s, d):
    return s.createDataFrame([(round(variogram.default_max_dist(field(s, d)), 6),)], "max_dist double")


@query("v4_cressie_hawkins", pairs_sql("fld", REACH, FIELD) + lags_sql("pow(avg(sqrt(abs(dz))),4)/(2*(0.457+0.494/count(*)))"))
def v4(s, d):
    return rounded(variogram.experimental_variogram(field(s, d), LAGS, REACH, "cressie"), "h", "gamma")


@query("v5_dowd", pairs_sql("fld", REACH, FIELD) + lags_sql(DOWD_SQL))
def v5(s, d):
    return rounded(variogram.experimental_variogram(field(s, d), LAGS, REACH, "dowd"), "h", "gamma")


@query("v6_madogram", pairs_sql("fld", REACH, FIELD) + lags_sql("0.5*avg(abs(dz))"))
def v6(s, d):
    return rounded(variogram.experimental_variogram(field(s, d), LAGS, REACH, "madogram"), "h", "gamma")


@query("v7_variogram_cloud", pairs_sql("fld", 0.1, FIELD) + " select i, j, round(d,6) h, round(0.5*dz*dz,6) gamma from pr")
def v7(s, d):
    return rounded(variogram.variogram_cloud(field(s, d), 0.1), "h", "gamma")


@query("v8_correlogram", pairs_sql("fld", REACH, FIELD) + ", vv as (select var_pop(v) vp from fld)" + lags_sql(MATHERON).replace("select l.lag", "select l.lag").replace("coalesce(n,0)::bigint n_pairs", "coalesce(n,0)::bigint n_pairs, round(1-g/(select vp from vv),6) rho"))
def v8(s, d):
    f = field(s, d)
    var = f.agg(F.var_pop("value")).first()[0]
    return rounded(variogram.correlogram(variogram.experimental_variogram(f, LAGS, REACH), var), "h", "gamma", "rho")


@query("v9_coincident_pairs", f"with {LATTICE}, q as (select id, v, floor(x/5) x, floor(y/5) y from lat) select count(*)::bigint coincident_pairs from q a, q b where a.id<b.id and a.x=b.x and a.y=b.y")
def v9(s, d):
    return variogram.coincident_pairs(lattice(s, d).withColumns({"x": F.floor(F.col("x") / 5), "y": F.floor(F.col("y") / 5)}))


@query("v10_cross_variogram", pairs_sql("fld", REACH, FIELD, extra=", b.s-a.s ds") + lags_sql("avg(0.5*dz*ds)"))
def v10(s, d):
    return rounded(variogram.cross_variogram(field(s, d), LAGS, REACH), "h", "gamma")


@query(
    "v11_variogram_map",
    f"""with {LATTICE}, pr as (select b.x-a.x dx, b.y-a.y dy, 0.5*(b.v-a.v)*(b.v-a.v) g from lat a, lat b where a.id<b.id and abs(b.x-a.x)<8 and abs(b.y-a.y)<8),
    bo as (select * from pr union all select -dx,-dy,g from pr), c as (select round(dx/2.0)::int ix, round(dy/2.0)::int iy, avg(g) gamma, count(*) n from bo group by 1,2)
    select i.ix::int ix, j.iy::int iy, i.ix*2.0::double hx, j.iy*2.0::double hy, round(gamma,4) gamma, coalesce(n,0)::bigint n_pairs from (select unnest(range(-3,4)) ix) i cross join (select unnest(range(-3,4)) iy) j left join c on c.ix=i.ix and c.iy=j.iy""",
)
def v11(s, d):
    return rounded(variogram.variogram_map(lattice(s, d), 3, 2.0), "gamma", digits=4)


@query("v12_default_lag_width", f"with {FIELD} select round(sqrt((max(x)-min(x))**2+(max(y)-min(y))**2)/2/10,6) lag_width from fld")
def v12(s, d):
    return s.createDataFrame([(round(variogram.default_lag_width(field(s, d), 10), 6),)], "lag_width double")


_RESID = "res as (select id, x, y, v-(regr_intercept(v,c1) over ()+regr_slope(v,c1) over ()*c1) v from fld)"


@query("v13_residual_variogram", pairs_sql("res", REACH, f"{FIELD}, {_RESID}") + lags_sql(MATHERON))
def v13(s, d):
    return rounded(variogram.experimental_variogram(transform.detrend(field(s, d), [F.col("c1")]), LAGS, REACH), "h", "gamma")


@query("a10_quantile_cutoffs", f"with {FIELD}, r as (select v, row_number() over (order by v)-1 k, count(*) over () n from fld) select q::double q, round(v,6) cutoff from r join (select unnest([0.25,0.5,0.75]) q) on k=least(floor(q*n),n-1)")
def a10(s, d):
    qs = [0.25, 0.5, 0.75]
    return rounded(s.createDataFrame(list(zip(qs, transform.quantile_cutoffs(field(s, d), qs))), "q double, cutoff double"), "cutoff")


CUTS = (-0.5, 0.5, 1.0)


@query(
    "m20_indicator_variograms",
    f"with {FIELD}, ind as (select id,x,y,c,(v<=z)::int::double v from fld cross join (select unnest([0,1,2]) c, unnest([-0.5,0.5,1.0]) z)), pr as (select a.c, sqrt((b.x-a.x)**2+(b.y-a.y)**2) d, b.v-a.v dz from ind a join ind b on a.c=b.c and a.id<b.id) "
    "select c::int cutoff, least(ceil(d/0.03)::int-1,9)::int lag, round(avg(d),6) h, round(avg(0.5*dz*dz),6) gamma, count(*)::bigint n_pairs from pr where d>0 and d<=0.3 group by 1,2",
)
def m20(s, d):
    return rounded(variogram.indicator_variograms(field(s, d), list(CUTS), LAGS, REACH), "h", "gamma")


@query("f4_indicator_coding", f"with {FIELD} select id, c::int cutoff, (v<=z)::int::double as \"value\" from fld cross join (select unnest([0,1,2]) c, unnest([-0.5,0.5,1.0]) z)")
def f4(s, d):
    return variogram.indicators(field(s, d), list(CUTS)).select("id", "cutoff", "value")


@query("m19_directional_set", f"with {FIELD}, pr as (select sqrt((b.x-a.x)**2+(b.y-a.y)**2) d, b.x-a.x dx, b.y-a.y dy, b.v-a.v dz from fld a, fld b where a.id<b.id) select az::double azimuth, least(ceil(d/0.03)::int-1,9)::int lag, round(avg(d),6) h, round(avg(0.5*dz*dz),6) gamma, count(*)::bigint n_pairs from pr cross join (select unnest([0.0,45.0,90.0,135.0]) az) where d>0 and d<=0.3 and abs(dx*sin(radians(az))+dy*cos(radians(az)))>=d*cos(radians(22.5)) group by 1,2")
def m19(s, d):
    return rounded(variogram.directional_variograms(field(s, d), [0.0, 45.0, 90.0, 135.0], 22.5, LAGS, REACH), "h", "gamma")


@query("j3_radius_join", f"with {FIELD}, {PTS2} select a.id a_id, b.id b_id, round(sqrt((b.x-a.x)**2+(b.y-a.y)**2),6) d from fld a, pts2 b where sqrt((b.x-a.x)**2+(b.y-a.y)**2)<=0.05")
def j3(s, d):
    return rounded(cross_pairs(field(s, d).select("id", "x", "y"), pts2(s, d), 0.05).select("a_id", "b_id", "d"), "d")


_KNN = "nn as (select t.id target_id, b.id id, sqrt((b.x-t.x)**2+(b.y-t.y)**2) d, b.v, row_number() over (partition by t.id order by (b.x-t.x)**2+(b.y-t.y)**2, b.id) rank from {t} t, fld b where {w})"


@query("j2_knn_join", f"with {FIELD}, {_KNN.format(t='fld', w='t.id<>b.id')} select target_id, id, rank::int rank, round(d,6) d from nn where rank<=8")
def j2(s, d):
    f = field(s, d)
    return rounded(knn_join(f, f, 8, exclude_self=True), "d")


@query("j2_knn_join_rings", f"with {FIELD}, {_KNN.format(t='fld', w='t.id<>b.id')} select target_id, id, rank::int rank, round(d,6) d from nn where rank<=4")
def j2_rings(s, d):
    f = field(s, d)
    return rounded(knn_join(f, f, 4, exclude_self=True, broadcast_points=0), "d")


@query("j7_coordinate_join", f"with {FIELD}, {PTS2} select a.id, round(a.v,6) as \"value\", round(b.v,6) secondary from fld a join pts2 b on a.x=b.x and a.y=b.y")
def j7(s, d):
    return rounded(variogram.collocate(field(s, d).select("id", "x", "y", "value"), pts2(s, d)).select("id", "value", "secondary"), "value", "secondary")


@query("s19_grid", f"with {FIELD}, b as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1 from fld) select (iy*20+ix)::bigint node, ix::int ix, iy::int iy, round(x0+(ix+0.5)*(x1-x0)/20,6) x, round(y0+(iy+0.5)*(y1-y0)/10,6) y from b cross join (select unnest(range(20)) ix) cross join (select unnest(range(10)) iy)")
def s19(s, d):
    """The grid over the points' box."""
    b = bbox(field(s, d).select("x", "y"))
    return rounded(Grid.from_bbox((b["min_x"], b["min_y"]), (b["max_x"], b["max_y"]), (20, 10)).frame(s), "x", "y")


@query("s18_raster_sample", f"with {FIELD} select id, case when floor((x+0.5)/0.1) between 0 and 9 and floor((y+0.5)/0.1) between 0 and 9 then (floor((y+0.5)/0.1)*10+floor((x+0.5)/0.1))::double end sampled from fld")
def s18(s, d):
    g = Grid.from_bbox((-0.5, -0.5), (0.5, 0.5), (10, 10))
    return sample_raster(field(s, d).select("id", "x", "y"), g.frame(s).withColumn("value", F.col("node").cast("double")), g).select("id", "sampled")


@query("dm_duplicates", f"with {LATTICE}, q as (select floor(x/5) x, floor(y/5) y from lat) select x, y, count(*)::bigint n_points from q group by 1,2 having count(*)>1")
def dups(s, d):
    return duplicates(lattice(s, d).withColumns({"x": F.floor(F.col("x") / 5).cast("double"), "y": F.floor(F.col("y") / 5).cast("double")}))


# Covariance models on a column of distances.
_G = {
    "spherical": "case when h<1 then 1.5*h-0.5*h*h*h else 1 end",
    "exponential": "1-exp(-h)",
    "gaussian": "1-exp(-h*h)",
    "matern32": "1-(1+sqrt(3)*h)*exp(-sqrt(3)*h)",
    "matern52": "1-(1+sqrt(5)*h+5*h*h/3)*exp(-sqrt(5)*h)",
    "circular": "case when h<1 then 1-2/pi()*(acos(least(h,1))-least(h,1)*sqrt(1-least(h,1)**2)) else 1 end",
    "stable": "1-exp(-pow(h,1.5))",
    "hole": "1-sin(h)/h",
    "wave": "1-sin(pi()*h)/(pi()*h)",
    "power": "pow(h*0.7,1.2)",
}
_P = {"stable": 1.5, "power": 1.2}


@query("m1_m9_model_families", f"with {FIELD}, p as (select id, sqrt(x*x+y*y)/0.7 h from fld) select id, " + ", ".join(f"round({g},6) {k}" for k, g in _G.items()) + " from p")
def m1_m9(s, d):
    h = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return field(s, d).select("id", *[F.round(unit_gamma_col(k, _P.get(k), h, 0.7), 6).alias(k) for k in _G])


NESTED = VariogramModel(0.1, (Structure("spherical", 0.6, 0.5, None, Anisotropy(40.0, 0.5)), Structure("exponential", 0.3, 0.2)))
_A40 = math.radians(40.0)
_HA = f"sqrt(({math.sin(_A40)!r}*x+{math.cos(_A40)!r}*y)**2+(({math.cos(_A40)!r}*x-{math.sin(_A40)!r}*y)/0.5)**2)/0.5"


@query("m10_nested_anisotropic", f"with {FIELD}, p as (select id, {_HA} ha, sqrt(x*x+y*y)/0.2 hb from fld), g as (select id, 0.1+0.6*(case when ha<1 then 1.5*ha-0.5*ha**3 else 1 end)+0.3*(1-exp(-hb)) gamma from p) select id, round(gamma,6) gamma, round(1.0-gamma,6) covariance from g")
def m10(s, d):
    f = field(s, d)
    return f.select("id", F.round(NESTED.gamma_col(F.col("x"), F.col("y")), 6).alias("gamma"), F.round(NESTED.cov_col(F.col("x"), F.col("y")), 6).alias("covariance"))


@query("f7_anisotropic_transform", f"with {FIELD} select id, round({math.sin(_A40)!r}*x+{math.cos(_A40)!r}*y,6) u, round(({math.cos(_A40)!r}*x-{math.sin(_A40)!r}*y)/0.5,6) w from fld")
def f7(s, d):
    m = Anisotropy(40.0, 0.5).matrix(2)
    return field(s, d).select("id", *[F.round(F.lit(float(r[0])) * F.col("x") + F.lit(float(r[1])) * F.col("y"), 6).alias(n) for r, n in zip(m, "uw")])


@query("t1_norm_cdf", f"with {FIELD} select id, round({norm_cdf_sql('v')},6) p from fld")
def t1(s, d):
    return field(s, d).select("id", F.round(norm_cdf_col(F.col("value")), 6).alias("p"))


@query("t2_inv_norm_cdf", f"with {FIELD} select id, round({inv_norm_sql('((id+0.5)/2001.0)')},6) score from fld")
def t2(s, d):
    return field(s, d).select("id", F.round(inv_norm_cdf_col((F.col("id") + 0.5) / 2001.0), 6).alias("score"))


_NS = "ns as (select v, (row_number() over (order by v,id)-0.5)/count(*) over () p from {t})"


@query("t3_normal_scores", f"with {LATTICE}, {_NS.format(t='lat')} select v as \"value\", round(avg({inv_norm_sql('p')}),6) score from ns group by 1")
def t3(s, d):
    return rounded(transform.normal_scores(lattice(s, d)), "score")


_DC = """{v}, o as (select unnest(range(4)) o), b as (select min(x) mx, min(y) my, count(*) n from {t}), c as (select id, v, s.cell, o.o, floor((x-mx+s.cell*o/4)/s.cell) cx, floor((y-my+s.cell*o/4)/s.cell) cy from {t}, b, o, (select unnest([{cells}]) cell) s),
k as (select cell, o, cx, cy, count(*) nc from c group by 1,2,3,4), q as (select cell, o, count(*) occ from k group by 1,2), w as (select c.id, c.v, c.cell, sum(1.0/(nc*occ))*(select n from b)/4 w from c join k using(cell,o,cx,cy) join q using(cell,o) group by 1,2,3)"""


@query("t8_decluster_weights", "with " + _DC.format(v=FIELD, t="fld", cells="0.2::double") + " select id, round(w,6) weight from w")
def t8(s, d):
    return rounded(transform.decluster(field(s, d).select("id", "x", "y", "value"), 0.2).select("id", "weight"), "weight")


@query("t9_decluster_scan", "with " + _DC.format(v=FIELD, t="fld", cells="0.1::double,0.2,0.3,0.4") + " select cell::double cell, round(sum(w*v)/sum(w),6) mean from w group by 1")
def t9(s, d):
    return rounded(transform.decluster_scan(field(s, d).select("id", "x", "y", "value"), [0.1, 0.2, 0.3, 0.4]), "mean")


_PR = f"with {FIELD}, p as (select category, count(*)*1.0/(select count(*) from fld) p from fld group by 1), c as (select category, p, sum(p) over (order by category) t from p)"


@query("a4_category_proportions", _PR + " select category::int category, round(p,6)::double proportion from p")
def a4(s, d):
    return rounded(transform.category_proportions(field(s, d), 10), "proportion")


@query("t10_truncation", _PR + f" select category::int category, round(p,6)::double proportion, case when category>0 then round({inv_norm_sql('(t-p)')},6) end as \"lower\", case when category<9 then round({inv_norm_sql('t')},6) end as \"upper\", round({inv_norm_sql('(t-p/2)')},6) pseudo from c")
def t10(s, d):
    return rounded(transform.truncation(transform.category_proportions(field(s, d), 10)), "proportion", "lower", "upper", "pseudo")


@query("t10_classify", f"with {FIELD} select id, ((v>-0.5)::int+(v>0.5)::int+(v>1.0)::int)::int category from fld")
def t10b(s, d):
    return field(s, d).select("id", transform.classify_col(F.col("value"), list(CUTS)).alias("category"))


@query("a5_collocated_stats", f"with {FIELD} select round(corr(v,s),6) rho, round(stddev_pop(v),6) std_primary, round(stddev_pop(s),6) std_secondary from fld")
def a5(s, d):
    return rounded(transform.collocated_stats(field(s, d)), "rho", "std_primary", "std_secondary")


@query("r1_ols_trend", f"with {FIELD} select round(regr_intercept(v,c1),6) b0, round(regr_slope(v,c1),6) b1 from fld")
def r1(s, d):
    c = transform.ols(field(s, d), [F.col("c1")])
    return s.createDataFrame([(round(float(c[0]), 6), round(float(c[1]), 6))], "b0 double, b1 double")


_RAW = "[c1+0.2, c2+0.5, c1+c2+0.6, 1.1+c1]"


@query(
    "k18_order_corrections",
    f"with {FIELD}, q as (select id, list_transform({_RAW}, lambda x: greatest(0.0,least(1.0,x))) c from fld) select id, round((list_max(c[1:1])+list_min(c[1:]))/2,6) f1, round((list_max(c[1:2])+list_min(c[2:]))/2,6) f2, round((list_max(c[1:3])+list_min(c[3:]))/2,6) f3, round((list_max(c)+list_min(c[4:]))/2,6) f4 from q",
)
def k18(s, d):
    c1, c2 = F.col("c1"), F.col("c2")
    out = field(s, d).withColumn("c", transform.order_corrections_col(F.array(c1 + 0.2, c2 + 0.5, c1 + c2 + 0.6, 1.1 + c1)))
    return out.select("id", *[F.round(F.get("c", k), 6).alias(f"f{k + 1}") for k in range(4)])


_T = "tg as (select id, x+0.013 x, y-0.007 y, v, s, c1 from fld)"


@query("k22_idw", f"with {FIELD}, {_T}, {_KNN.format(t='tg', w='true')} select target_id id, round(sum(v/(d*d))/sum(1/(d*d)),6) prediction from nn where rank<=12 group by 1")
def k22(s, d):
    return rounded(interpolation.idw(_targets(s, d), field(s, d), 2.0, 12), "prediction")


def _targets(s, d, *more):
    return field(s, d).select("id", (F.col("x") + 0.013).alias("x"), (F.col("y") - 0.007).alias("y"), *more)


@query("k23_knn_mean", f"with {FIELD}, {_T}, {_KNN.format(t='tg', w='true')} select target_id id, round(avg(v),6) prediction from nn where rank<=8 group by 1")
def k23(s, d):
    return rounded(interpolation.knn_mean(_targets(s, d), field(s, d), 8), "prediction")


_CVI = f"with {FIELD}, {_KNN.format(t='fld', w='t.id<>b.id')}"
_IDWCV = "cv as (select f.id, f.v observed, p.predicted from fld f join (select target_id id, sum(v/(d*d))/sum(1/(d*d)) predicted from nn where rank<=12 group by 1) p using(id))"


@query("c10_idw_cv", f"{_CVI}, {_IDWCV} select id, round(observed,6) observed, round(predicted,6) predicted from cv")
def c10(s, d):
    return rounded(interpolation.idw_cross_validate(field(s, d), 2.0, 12).drop("variance"), "observed", "predicted")


@query("c10_knn_cv", f"{_CVI} select target_id id, round(avg(v),6) predicted from nn where rank<=8 group by 1")
def c10b(s, d):
    return rounded(interpolation.knn_cross_validate(field(s, d), 8).select("id", "predicted"), "predicted")


@query(
    "c6_metrics",
    f"{_CVI}, {_IDWCV}, m as (select avg(observed) m from cv) select count(*)::bigint n, round(avg(predicted-observed),6) me, round(avg(abs(predicted-observed)),6) mae, round(avg((predicted-observed)**2),6) mse, round(sqrt(avg((predicted-observed)**2)),6) rmse, round(100*avg(observed-predicted)/any_value(m),4) rme, round(100*avg(abs(observed-predicted))/any_value(m),4) rmae, round(100*sqrt(avg((predicted-observed)**2))/any_value(m),4) rrmse, round(100*(1-sum((predicted-observed)**2)/sum((observed-m)**2)),6) vecv, round(100*(1-sum(abs(predicted-observed))/sum(abs(observed-m))),6) e1, null::double msdr from cv, m",
)
def c6(s, d):
    out = validate.metrics(interpolation.idw_cross_validate(field(s, d), 2.0, 12))
    return rounded(rounded(out, "me", "mae", "mse", "rmse", "vecv", "e1"), "rme", "rmae", "rrmse", digits=4)


@query("c8_accuracy_plot", f"with {FIELD}, q as (select v observed, s predicted, 0.02::double variance from fld) select p::double p, round(avg((abs(observed-predicted)<={inv_norm_sql('((1+p)/2)')}*sqrt(variance))::int),6) observed_p from q cross join (select unnest([0.1,0.3,0.5,0.7,0.9]) p) group by 1")
def c8(s, d):
    cv = field(s, d).select("id", F.col("value").alias("observed"), F.col("secondary").alias("predicted"), F.lit(0.02).alias("variance"))
    return rounded(validate.accuracy_plot(cv, [0.1, 0.3, 0.5, 0.7, 0.9]), "observed_p")


@query("c7_rps", f"with {FIELD}, q as (select v, [least(1,abs(c1)), least(1,abs(c1)+0.2), least(1,abs(c1)+0.5)] f from fld) select round(avg((pow(f[1]-(v<=-0.5)::int,2)+pow(f[2]-(v<=0.5)::int,2)+pow(f[3]-(v<=1.0)::int,2))/3),6) rps from q")
def c7(s, d):
    one = F.lit(1.0)
    a = F.abs("c1")
    rows = field(s, d).select(F.col("value").alias("observed"), F.array(F.least(one, a), F.least(one, a + 0.2), F.least(one, a + 0.5)).alias("ccdf"))
    return rounded(validate.rps(rows, list(CUTS)), "rps")


@query("c12_tune_idw", f"{_CVI}, e as (select p, target_id id, sum(v*pow(d,-p))/sum(pow(d,-p)) pr from nn cross join (select unnest([0.5,1.0,2.0,3.0]) p) where rank<=16 group by 1,2) select p::double param, round(100*(1-sum((fld.v-pr)**2)/(var_pop(fld.v)*count(*))),6) vecv from e join fld using(id) group by 1")
def c12(s, d):
    return rounded(interpolation.tune_idw_power(field(s, d), (0.5, 1.0, 2.0, 3.0), 16), "vecv")


@query("c12_tune_knn", f"{_CVI}, e as (select k, target_id id, avg(v) pr from nn cross join (select unnest([1,2,4,8,16]) k) where rank<=k group by 1,2) select k::double param, round(100*(1-sum((fld.v-pr)**2)/(var_pop(fld.v)*count(*))),6) vecv from e join fld using(id) group by 1")
def c12b(s, d):
    return rounded(interpolation.tune_knn_k(field(s, d), (1, 2, 4, 8, 16)), "vecv")


@query("c4_block_folds", f"with {FIELD}, b as (select min(x) ax, max(x) bx, min(y) ay, max(y) dy from fld) select id, (greatest(0,least(2,floor((x-ax)/((bx-ax)/3))))+3*greatest(0,least(1,floor((y-ay)/((dy-ay)/2)))))::int fold from fld, b")
def c4f(s, d):
    return kriging.block_fold(field(s, d), (3, 2)).select("id", "fold")


EXPO = single("exponential", 0.9, 0.4, 0.1)
# Two neighbours: the ordinary system in closed form.
_K2 = f"""with {FIELD}, {_T}, {_KNN.format(t='tg', w='true')}, w as (select a.target_id id, 0.9*exp(-a.d/0.4) b1, 0.9*exp(-b.d/0.4) b2, 0.9*exp(-sqrt((p.x-q.x)**2+(p.y-q.y)**2)/0.4) c12, a.v z1, b.v z2 from nn a join nn b on a.target_id=b.target_id and a.rank=1 and b.rank=2 join fld p on p.id=a.id join fld q on q.id=b.id)"""


@query("k1_ordinary_kriging", _K2 + ", s as (select *, 0.5+(b1-b2)/(2*(1-c12)) w1 from w), t as (select *, b1-w1-c12*(1-w1) mu from s) select id, round(w1*z1+(1-w1)*z2,6) prediction, round(greatest(0,1-(w1*b1+(1-w1)*b2+mu)),6) variance, round(mu,6) lagrange from t")
def k1(s, d):
    return rounded(kriging.krige(_targets(s, d), field(s, d), EXPO, neighbors=kriging.Neighbors(max=2)).drop("x", "y"), "prediction", "variance", "lagrange")


@query("k2_simple_kriging", _K2 + ", s as (select *, (b1-c12*b2)/(1-c12*c12) w1, (b2-c12*b1)/(1-c12*c12) w2 from w) select id, round(0.3+w1*(z1-0.3)+w2*(z2-0.3),6) prediction, round(greatest(0,1-(w1*b1+w2*b2)),6) variance from s")
def k2(s, d):
    return rounded(kriging.krige(_targets(s, d), field(s, d), EXPO, method="simple", mean=0.3, neighbors=kriging.Neighbors(max=2)).select("id", "prediction", "variance"), "prediction", "variance")


@query("k6_measurement_error", _K2 + ", s as (select *, (1.2*b1-c12*b2)/(1.44-c12*c12) w1, (1.2*b2-c12*b1)/(1.44-c12*c12) w2 from w) select id, round(0.3+w1*(z1-0.3)+w2*(z2-0.3),6) prediction, round(greatest(0,1-(w1*b1+w2*b2)),6) variance from s")
def k6(s, d):
    f = field(s, d).withColumn("err", F.lit(0.2))
    return rounded(kriging.krige(_targets(s, d), f, EXPO, error="err", method="simple", mean=0.3, neighbors=kriging.Neighbors(max=2)).select("id", "prediction", "variance"), "prediction", "variance")


@query("k12_lognormal_kriging", (_K2.replace("a.v z1, b.v z2", "ln(a.v+3) z1, ln(b.v+3) z2")) + ", s as (select *, 0.5+(b1-b2)/(2*(1-c12)) w1 from w), t as (select *, b1-w1-c12*(1-w1) mu from s), u as (select *, greatest(0,1-(w1*b1+(1-w1)*b2+mu)) var from t) select id, round(exp(w1*z1+(1-w1)*z2+var/2-mu),6) estimate, round(var,6) log_variance from u")
def k12(s, d):
    f = field(s, d).withColumn("value", F.col("value") + 3)
    return rounded(kriging.lognormal_kriging(_targets(s, d), f, EXPO, neighbors=kriging.Neighbors(max=2)).select("id", "estimate", "log_variance"), "estimate", "log_variance")


@query("c1_leave_one_out", (_K2.replace("from tg t, fld b where true", "from fld t, fld b where t.id<>b.id")) + ", s as (select *, 0.5+(b1-b2)/(2*(1-c12)) w1 from w), t as (select *, b1-w1-c12*(1-w1) mu from s) select id, round(fld.v,6) observed, round(w1*z1+(1-w1)*z2,6) predicted, round(greatest(0,1-(w1*b1+(1-w1)*b2+mu)),6) variance from t join fld using(id)")
def c1(s, d):
    return rounded(kriging.leave_one_out(field(s, d), EXPO, neighbors=kriging.Neighbors(max=2)), "observed", "predicted", "variance")


NEAR = kriging.Neighbors(max=16)


@query("k3_universal_kriging")
def k3(s, d):
    return kriging.krige(_targets(s, d), field(s, d), EXPO, method="universal", degree=2, neighbors=NEAR)


def _drift_targets(s, d):
    return _targets(s, d, "c1")


@query("k4_external_drift")
def k4(s, d):
    return kriging.krige(_drift_targets(s, d), field(s, d), EXPO, ("c1",), method="drift", neighbors=NEAR)


@query("k5_power_model")
def k5(s, d):
    return kriging.krige(_targets(s, d), field(s, d), single("power:1.2", 2.0, 1.0), neighbors=NEAR)


@query("k8_grid_kriging")
def k8(s, d):
    return kriging.krige_grid(Grid.from_bbox((-0.5, -0.5), (0.5, 0.5), (100, 100)), field(s, d), EXPO, neighbors=kriging.Neighbors(max=32))


@query("k9_block_kriging")
def k9(s, d):
    return kriging.krige_grid(Grid.from_bbox((-0.5, -0.5), (0.5, 0.5), (20, 20)), field(s, d), EXPO, neighbors=NEAR, block=((0.05, 0.05), (4, 4)))


@query("k10_octant_ellipsoid")
def k10(s, d):
    return kriging.krige(_targets(s, d), field(s, d), EXPO, neighbors=kriging.Neighbors(max=12, radius=0.6, min=3, per_octant=3, ellipsoid=Anisotropy(30.0, 0.5)))


@query("k11_global_neighborhood")
def k11(s, d):
    return kriging.krige(_targets(s, d), field(s, d), EXPO, neighbors=kriging.Neighbors())


@query("k21_regression_kriging")
def k21(s, d):
    f = field(s, d)
    c = transform.ols(f, [F.col("c1")])
    trend = transform.trend_col(c, [F.col("c1")])
    return kriging.regression_kriging(_drift_targets(s, d).withColumn("trend", trend), f.withColumn("trend", trend), EXPO, neighbors=NEAR)


@query("c2_loo_drift")
def c2(s, d):
    return kriging.leave_one_out(field(s, d), EXPO, ("c1",), method="drift", neighbors=NEAR)


@query("c3_k_fold")
def c3(s, d):
    return kriging.leave_one_out(kriging.shuffled_fold(field(s, d), 5), EXPO, fold="fold", neighbors=NEAR)


@query("c4_block_cv")
def c4(s, d):
    return kriging.leave_one_out(kriging.block_fold(field(s, d), (3, 3)), EXPO, fold="fold", neighbors=NEAR)


@query("c5_loo_lognormal")
def c5(s, d):
    return kriging.leave_one_out_lognormal(field(s, d).withColumn("value", F.col("value") + 3), EXPO, neighbors=NEAR)
