"""Further queries over the adapters of the registry: ingestion, weighted vector scores, weights, refits and acceptance tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from isofield.functions import columns as C
from isofield.operators import graph as G
from isofield.operators import potential as P
from isofield.operators import regression as L
from isofield.operators import relational as R
from isofield.operators import summaries as M
from isofield.operators import weights as T
from isofield.plans.registry import EDGES, GRID, PAIRS, POINTS, PROBABILITY, SURVEY, edges8, grid, pairs, points, probability, query, read, rounded, survey
from isofield.sources.shared import cut, fresh
from isofield.sources.tables import resume


def vectors(spark, d):
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    t, p = [at(k) for k in range(3)], [at(k) * 0.6 + at(k + 3) * 0.4 for k in range(3)]
    return read(spark, d, "embeddings").select(F.col("label").alias("region"), *[c.alias(f"t{k + 1}") for k, c in enumerate(t)], *[c.alias(f"p{k + 1}") for k, c in enumerate(p)],
                                               (1 + F.col("vec_id") % 5).cast("double").alias("w"))


VECTORS = """vectors as (select label region, embedding[1]::double t1, embedding[2]::double t2, embedding[3]::double t3, embedding[1]::double * 0.6::double + embedding[4]::double * 0.4::double p1,
 embedding[2]::double * 0.6::double + embedding[5]::double * 0.4::double p2, embedding[3]::double * 0.6::double + embedding[6]::double * 0.4::double p3, (1 + vec_id % 5)::double w from embeddings)"""
TRUTH, PREDICTED = ["t1", "t2", "t3"], ["p1", "p2", "p3"]


# Ingestion.

@query("""with t as (select c_custkey id, c_mktsegment segment, case when c_custkey % 7 = 0 then 'n/a' when c_custkey % 5 = 0 then 'NaN' else cast(c_nationkey as varchar) end number,
  '1995-0' || (c_custkey % 9 + 1) || '-' || lpad(cast(c_custkey % 40 as varchar), 2, '0') "day" from customer)
 select count(*) n, count(case when isfinite(try_cast(number as double)) then 1 end) numbers, sum(case when isfinite(try_cast(number as double)) then try_cast(number as double) end) total, count(try_cast("day" as date)) as days,
  cast(max(try_cast("day" as date)) as varchar) latest, count_if(segment = 'BUILDING') renamed, min('a' || replace(printf('%.2f', id / 8.0), '.', 'p')) token from t""")
def coerced_columns(spark, d):
    id_ = F.col("c_custkey")
    t = read(spark, d, "customer").select(
        "c_custkey", "c_mktsegment", F.when(id_ % 7 == 0, "n/a").when(id_ % 5 == 0, "NaN").otherwise(F.col("c_nationkey").cast("string")).alias("number"),
        F.concat(F.lit("1995-0"), (id_ % 9 + 1).cast("string"), F.lit("-"), F.lpad((id_ % 40).cast("string"), 2, "0")).alias("day"))
    number, day = C.coerced(F.col("number")), C.iso_date(F.col("day"))
    renamed = C.relabelled(F.col("c_mktsegment"), {"BUILDING": "construction", "MACHINERY": "machines"}) == "construction"
    return t.agg(F.count(F.lit(1)).alias("n"), F.count(number).alias("numbers"), F.sum(number).alias("total"), F.count(day).alias("days"), F.max(day).cast("string").alias("latest"),
                 F.count_if(renamed).alias("renamed"), F.min(C.token("a", id_ / 8, 2)).alias("token"))


@query(f"with {PAIRS} select region, count(*) n, round(sum(r), 4) total from (select region, case when t > 20 then ln(t - 20) end r from pairs) where r is not null group by 1")
def complete_rows(spark, d):
    rows = pairs(spark, d).select("region", F.when(F.col("t") > 20, F.log(F.col("t") - 20)).otherwise(F.lit(float("nan"))).alias("r"))
    return R.complete(rows, ["r"]).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r"), 4).alias("total"))


@query("""select distinct round(l_discount, 2)::double gamma, (case when round(l_discount, 2) = 0 then 1.0 else l_tax end)::double cap, p_size n from lineitem join part on l_partkey = p_partkey""")
def distinct_configurations(spark, d):
    li = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    c = li.select(F.round(F.col("l_discount").cast("double"), 2).alias("gamma"), F.col("l_tax").cast("double").alias("cap"), F.col("p_size").alias("n"), "l_orderkey", "l_linenumber")
    return R.distinct_configurations(c, ["gamma", "cap", "n"], ["l_orderkey", "l_linenumber"], {"cap": ("gamma", 1.0)}).select("gamma", "cap", "n")


@query(f"""with {GRID}, best as (select seed, loss_name, n_basis from (select *, row_number() over (partition by seed, loss_name order by score, n_basis, lam, pw) k from grid) where k = 1)
 select g.seed, g.loss_name, g.n_basis, lam, pw, score from grid g join best b on g.seed = b.seed and g.loss_name = b.loss_name and g.n_basis = b.n_basis""")
def candidates_at_chosen_basis(spark, d):
    g, keys = cut(grid(spark, d)), ["seed", "loss_name"]
    chosen = R.argmin(g, keys, "score", ["n_basis", "lam", "pw"]).select(*keys, F.col("n_basis").alias("practical"))
    return R.at_chosen(g, chosen, keys, "n_basis", "practical").select("seed", "loss_name", "n_basis", "lam", "pw", "score")


@query(f"""with {GRID} select loss_name, seed, n_basis, lam, pw, score, row_number() over (order by seed, loss_name, n_basis, lam, pw) - 1 candidate_id from grid where seed <= 3""")
def resumed_candidates(spark, d):
    """Blocks of a grid built in two runs, the second finding one block of the first cut off, numbered over all blocks."""
    g, place, keys = cut(grid(spark, d)), fresh(spark), ["seed", "loss_name"]
    blocks = g.where("seed <= 3").select(*keys).distinct()
    build = lambda missing: g.join(missing, keys)
    resume(spark, place, blocks.where("seed <= 2"), keys, build)
    half = g.where("seed = 2 and loss_name = 'N'").drop("seed", "loss_name").limit(1)
    half.write.mode("append").parquet(f"{place}/data/seed=2/loss_name=N")
    return resume(spark, place, blocks, keys, build, ["seed", "loss_name", "n_basis", "lam", "pw"]).select("loss_name", "seed", "n_basis", "lam", "pw", "score", "candidate_id")


MAGNITUDES = """magnitudes as (select -23.5 + 6.5 * pow((id % 1000) / 1000.0, 0.4) m, -23.5 + 6.5 * pow((id % 1000) / 1000.0, 0.4) + 0.1 + (id % 17) / 8.0 l from survey)"""


@query(f"""with {SURVEY}, {MAGNITUDES}, g as (select i, -24.0 + 9.0 * i / 4095 x from (select unnest(range(4096)) i)), p as (select unnest([-22.5, -21.0]) knee, unnest([-1.2, -0.7]) slope),
 d as (select knee, slope, i, x, pow(10.0, (slope + 1) * 0.4 * (knee - x)) * exp(-pow(10.0, 0.4 * (knee - x))) f from g, p),
 a as (select knee, slope, i, sum(step) over (partition by knee, slope order by i) area from (select knee, slope, i, coalesce((f + lag(f) over (partition by knee, slope order by i)) / 2 * (9.0 / 4095), 0) step from d)),
 r as (select m, least(4094, floor((least(l, -15.0) + 24.0) / (9.0 / 4095))::bigint) c, (least(l, -15.0) + 24.0) / (9.0 / 4095) z from magnitudes)
 select a.knee, round(sum(ln(a.area + (z - c) * (b.area - a.area)) - (a.slope + 1) * 0.4 * (a.knee - m) * ln(10.0) + pow(10.0, 0.4 * (a.knee - m))), 3) loss
 from r join a on a.i = c join a b on b.i = c + 1 and b.knee = a.knee group by a.knee""")
def luminosity_likelihood(spark, d):
    """The truncated likelihood of magnitudes with limits of their own, at two points; the fit reads the same sums."""
    u = F.pow((F.col("id") % 1000) / 1000.0, F.lit(0.4))
    m = survey(spark, d).select((F.lit(-23.5) + 6.5 * u).alias("m"), "id").withColumn("l", F.col("m") + 0.1 + (F.col("id") % 17) / 8.0)
    rows = [(k, round(T.fit_luminosity(m, "m", "l", -24.0, -15.0, (k, s), rounds=0)[2], 3)) for k, s in ((-22.5, -1.2), (-21.0, -0.7))]
    return spark.createDataFrame(rows, "knee double, loss double")


# Vector scores.

def _read_off(steps: str, q: float) -> str:
    return f"(select region, max(case when c >= {q} and (c0 is null or c0 < {q}) then coalesce(v0 + (v - v0) * ({q} - c0) / (c - c0), v) end) q from {steps} group by 1)"


def _steps(value: str) -> str:
    return f"""(select *, lag(v) over k v0, lag(c) over k c0 from (select region, v, sum(w) over (partition by region order by v) / sum(w) over (partition by region) c
  from (select region, {value} v, sum(w) w from each_ group by all)) window k as (partition by region order by v))"""


EACH = """each_ as (select *, sqrt(t1*t1+t2*t2+t3*t3) ts, sqrt(p1*p1+p2*p2+p3*p3) ps, degrees(acos(greatest(-1.0, least(1.0, (p1*t1+p2*t2+p3*t3) / (sqrt(t1*t1+t2*t2+t3*t3)*sqrt(p1*p1+p2*p2+p3*p3)))))) angle from vectors)"""


@query(f"""with {VECTORS}, {EACH}, a as {_steps('angle')}, s as {_steps('abs((ps - ts) / ts)')},
 g as (select region, count(*) n, sqrt(sum(w*((p1-t1)**2+(p2-t2)**2+(p3-t3)**2))/sum(w)) rmse_3d, sqrt(sum(w*((p1-t1)**2+(p2-t2)**2+(p3-t3)**2))/sum(w*(t1*t1+t2*t2+t3*t3))) nrmse, sqrt(sum(w*(p1-t1)**2)/sum(w)) rmse_x,
  (sum(w*p1*t1)/sum(w) - sum(w*p1)/sum(w)*sum(w*t1)/sum(w)) / sqrt((sum(w*t1*t1)/sum(w) - (sum(w*t1)/sum(w))**2) * (sum(w*p1*p1)/sum(w) - (sum(w*p1)/sum(w))**2)) corr_x,
  sqrt((sum(w*(p1-t1))/sum(w))**2 + (sum(w*(p2-t2))/sum(w))**2 + (sum(w*(p3-t3))/sum(w))**2) mean_residual from vectors group by 1)
 select g.region, n, round(rmse_3d, 5) rmse_3d, round(nrmse, 5) nrmse, round(rmse_x, 5) rmse_x, round(corr_x, 5) corr_x, round(mean_residual, 5) mean_residual, round(m.q, 3) angle_median, round(h.q, 3) angle_p90, round(f.q, 4) speed_error_median
 from g join {_read_off('a', 0.5)} m on g.region = m.region join {_read_off('a', 0.9)} h on g.region = h.region join {_read_off('s', 0.5)} f on g.region = f.region""")
def weighted_vector_metrics(spark, d):
    m = M.weighted_vector_metrics(vectors(spark, d), ["region"], TRUTH, PREDICTED, "w")
    digits = {"rmse_3d": 5, "nrmse": 5, "rmse_x": 5, "corr_x": 5, "mean_residual": 5, "angle_median": 3, "angle_p90": 3, "speed_error_median": 4}
    return m.select("region", "n", *[F.round(c, k).alias(c) for c, k in digits.items()])


@query(f"""with {VECTORS} select region, round((sum(w*p1*t1)/sum(w) - sum(w*p1)/sum(w)*sum(w*t1)/sum(w)) / (sum(w*t1*t1)/sum(w) - (sum(w*t1)/sum(w))**2), 5) slope_x,
 round(sum(w*p2*t2)/sum(w*t2*t2), 5) origin_slope_y, round(sum(w*(p1*t1+p2*t2+p3*t3))/sum(w*(t1*t1+t2*t2+t3*t3)), 5) gain from vectors group by 1""")
def vector_calibration(spark, d):
    return rounded(M.vector_calibration(vectors(spark, d), ["region"], TRUTH, PREDICTED, F.col("w")).select("region", "slope_x", "origin_slope_y", "gain"), 5)


@query(f"""with {VECTORS}, {EACH} select region, round(sqrt(sum(ps*ps)/sum(ts*ts)), 5) size_ratio, round(quantile_cont(angle, 0.5), 3) angle_median, round(quantile_cont(angle, 0.9), 3) angle_p90 from each_ group by 1""")
def direction_summary(spark, d):
    m = M.direction_summary(vectors(spark, d), ["region"], TRUTH, TRUTH, PREDICTED)
    return m.select("region", F.round("size_ratio", 5).alias("size_ratio"), F.round("angle_median", 3).alias("angle_median"), F.round("angle_p90", 3).alias("angle_p90"))


@query(f"""with {VECTORS}, c as (select 'full' candidate, t1, t2, t3, p1, p2, p3 from vectors union all select 'half', t1, t2, t3, p1 * 0.5, p2 * 0.5, p3 * 0.5 from vectors union all select 'swapped', t1, t2, t3, p2, p1, p3 from vectors)
 select candidate, count(*) n, round(sqrt(sum((p1-t1)**2+(p2-t2)**2+(p3-t3)**2)/sum(t1*t1+t2*t2+t3*t3)), 5) nrmse_3d, round(sqrt(sum((p1-t1)**2)/sum(t1*t1)), 5) nrmse_radial from c group by 1""")
def candidate_metrics(spark, d):
    v = vectors(spark, d).withColumns({"one": F.lit(1.0), "nil": F.lit(0.0), **{f"h{k}": F.col(f"p{k}") * 0.5 for k in (1, 2, 3)}})
    m = M.candidate_metrics(v, [], ["one", "nil", "nil"], TRUTH, {"full": PREDICTED, "half": ["h1", "h2", "h3"], "swapped": ["p2", "p1", "p3"]})
    return rounded(m.select("candidate", "n", "nrmse_3d", "nrmse_radial"), 5)


# Weights.

@query(f"""with {SURVEY}, l as (select unnest([10.0, 11.5, 12.0])::double m_lim)
 select id, round(avg(case when m <= -24.0 then 0.0 when m < -20.0 then (m + 24.0) * (0.4 / 4.0) when m < -14.0 then 0.4 + (m + 20.0) * (0.6 / 6.0) else 1.0 end), 6) pr from (select s.id, l.m_lim - 5 * log10(s.dist) - 25 m from survey s, l) group by 1""")
def mean_probability(spark, d):
    p = T.mean_probability(F.col("dist"), [10.0, 11.5, 12.0], [-24.0, -20.0, -14.0], [0.0, 0.4, 1.0])
    return rounded(survey(spark, d).select("id", T.probability_by_mode("global", F.lit(0.0), p).alias("pr")))


@query(f"""with {PROBABILITY}, raw as (select pr, pow(greatest(pr, 1e-3), -0.5) r from prob), cap as (select least(50.0, quantile_cont(r, 0.995)) c from raw), k as (select pr, least(r, c) w from raw, cap)
 select count(*) n, round(min(pr), 6) probability_min, round(quantile_cont(pr, 0.5), 6) probability_median, round(max(w) / avg(w), 6) weight_max, round(sum(w) * sum(w) / sum(w * w), 4) effective, round(sum(w) * sum(w) / sum(w * w) / count(*), 6) effective_share from k""")
def weight_report(spark, d):
    return rounded(T.weight_report(T.inverse_weights(probability(spark, d), "pr", power=0.5), "pr", "weight").withColumn("effective", F.round("effective", 4)))


@query(f"""with {SURVEY}, r as (select *, 1 + 2.0 * pow(greatest(0, least(1, dist / 50)), 1.5) raw from survey),
 m as (select sqrt(avg(raw * raw)) a, sqrt(avg(raw)) b from r where region < 6) select id, round(raw / a, 6) profile_correct, round(sqrt(raw) / b, 6) profile_flattened, 1.0::double profile_constant from r, m""")
def working_profiles(spark, d):
    train = F.col("region") < 6
    p = T.working_profiles(T.error_profile(survey(spark, d), "dist", 50.0, 3.0, 1.5, train), "profile", train)
    return rounded(p.select("id", "profile_correct", "profile_flattened", "profile_constant"))


@query(f"""with {PROBABILITY}, t as (select *, dist / (1 + id % 7) gap from prob), c as (select * from t where id % 3 <> 0), edge as (select region, quantile_cont(dist, 0.995) far from c group by 1),
 q as (select t.*, gap <= 1.5 * (select quantile_cont(gap, 0.95) from c) and dist <= far near from t left join edge on t.region = edge.region)
 select id, coalesce(near and pr >= 0.1, false) extended, coalesce(near and pr >= 0.3, false) as "strict", coalesce(near and pr >= 0.3 and dist <= 20.0, false) as "primary" from q""")
def support_masks(spark, d):
    t = probability(spark, d).withColumn("gap", F.col("dist") / (1 + F.col("id") % 7))
    return T.support_masks(t, t.where("id % 3 <> 0"), "region", "dist", "gap", "pr", 30.0, 10.0, (0.1, 0.3)).select("id", "extended", "strict", "primary")


# Fields and fits.

@query(f"""with {EDGES}, k as (select e.src, dist, vx, vy, vz, exp(-(dist/0.2)*(dist/0.2)) * (1 + e.dst % 3) w from edges e join points on dst = id),
 m as (select src, sum(w*vx)/sum(w) mx, sum(w*vy)/sum(w) my, sum(w*vz)/sum(w) mz from k group by 1)
 select k.src, round(any_value(mx), 6) vx, round(sqrt(sum(w*((vx-mx)**2+(vy-my)**2+(vz-mz)**2))/sum(w)), 5) dispersion from k join m on k.src = m.src group by 1""")
def bulk_field_dispersion(spark, d):
    v = points(spark, d).select("id", "vx", "vy", "vz", (1 + F.col("id") % 3).cast("double").alias("mass"))
    b = G.bulk_field(edges8(spark, d), v, 0.2, ["vx", "vy", "vz"], "mass", True)
    return b.select("src", F.round("vx", 6).alias("vx"), F.round("dispersion", 5).alias("dispersion"))


@query(f"""with {PAIRS}, part as (select *, case when region < 5 then 'train' when region < 7 then 'validation' else 'test' end s from pairs),
 m as (select sum(p)/count(*) u, sum(t)/count(*) b, sum(t*t)/count(*) c, sum(t*p)/count(*) v from part where s = 'train'),
 f as (select unnest([1, 2, 2]) n, unnest([0.1, 0.1, 10.0]::double[]) st), th as (select n, st, case when n = 1 then u else (u*(c+st) - b*v)/((c+st) - b*b) end a, case when n = 1 then 0 else (v - b*u)/((c+st) - b*b) end e from f, m),
 sc as (select n, st, sqrt(sum((a+e*t-p)**2)/sum(p*p)) nrmse from th, part where s = 'validation' group by all), best as (select n, st, nrmse from sc order by nrmse, n, st limit 1),
 m2 as (select sum(p)/count(*) u, sum(t)/count(*) b, sum(t*t)/count(*) c, sum(t*p)/count(*) v from part where s <> 'test'),
 t2 as (select n, st, nrmse, case when n = 1 then u else (u*(c+st) - b*v)/((c+st) - b*b) end a, case when n = 1 then 0 else (v - b*u)/((c+st) - b*b) end e from best, m2)
 select n n_basis, st strength, round(any_value(nrmse), 5) validation_nrmse, round(sqrt(sum((a+e*t-p)**2)/sum(p*p)), 5) test_nrmse from t2, part where s = 'test' group by all""")
def spectral_refit(spark, d):
    rows = pairs(spark, d).withColumn("design", F.array(F.lit(1.0), "t"))
    chosen, theta = L.select_and_refit(rows.where("region < 5"), rows.where("region in (5, 6)"), "design", "p", np.array([0.0, 1.0]), [1, 2], [0.1, 10.0], [1.0])
    test = L.predict(rows.where("region >= 7"), "design", theta, "fit").agg(F.round(M.nrmse(F.col("p"), F.col("fit")), 5).alias("test_nrmse"))
    return test.select(F.lit(chosen["n_basis"]).alias("n_basis"), F.lit(chosen["strength"]).alias("strength"), F.lit(round(chosen["nrmse"], 5)).alias("validation_nrmse"), "test_nrmse")


@query(f"""with {POINTS}, m as (select avg(vx) a, avg(vy) b, avg(vz) c from points where id % 4 <> 0)
 select 'zero' baseline, count(*) n, 1.0::double nrmse from points where id % 4 = 0 union all
 select 'mean', count(*), round(sqrt(sum((vx-a)**2+(vy-b)**2+(vz-c)**2)/sum(vx*vx+vy*vy+vz*vz)), 6) from points, m where id % 4 = 0""")
def baseline_scores(spark, d):
    p = points(spark, d)
    return rounded(L.baselines(p.where("id % 4 <> 0"), p.where("id % 4 = 0"), ["vx", "vy", "vz"]))


@query(f"""with {POINTS}, r as (select id, x, y, 1.5 * x - 2.0 * y t, unnest([1.0, 0.5 + id % 3]) w, unnest(['none', 'positive']) weighting from points),
 m as (select weighting, sum(w*x*x) a, sum(w*x*y) b, sum(w*y*y) d, sum(w*x*t) u, sum(w*y*t) v from r where id % 5 <> 0 group by 1),
 c as (select weighting, (u*d - b*v) / (a*d - b*b) p, (a*v - b*u) / (a*d - b*b) q from m)
 select c.weighting, 2 n_basis, round(any_value(p), 6) theta0, round(any_value(q), 6) theta1, round(sqrt(sum((p*x + q*y - t)**2) / sum(t*t)), 7) held_out_error, 'pass' status from c join r on r.weighting = c.weighting where id % 5 = 0 group by 1""")
def closure_test(spark, d):
    rows = points(spark, d).withColumn("design", F.array("x", "y"))
    found = []
    for w, c in (("none", None), ("positive", 0.5 + F.col("id") % 3)):
        r = L.closure(rows.where("id % 5 <> 0"), rows.where("id % 5 = 0"), "design", np.array([1.5, -2.0]), c)
        found.append((w, r["n_basis"], *[round(float(v), 6) for v in r["found"]], round(r["held_out_error"], 7), r["status"]))
    return spark.createDataFrame(found, "weighting string, n_basis int, theta0 double, theta1 double, held_out_error double, status string")


@query(f"""with {POINTS}, g as (select 1 k, 4.0::double s union all select 2, 4.0 union all select 1, 0.01 union all select 2, 0.01),
 tr as (select * from points where id % 4 <> 0), va as (select * from points where id % 4 = 0),
 m as (select count(*)::double n, sum(x*x)/count(*) a, sum(x*y)/count(*) b, sum(y*y)/count(*) d, sum(x*vx)/count(*) ux, sum(y*vx)/count(*) wx, sum(x*vy)/count(*) uy, sum(y*vy)/count(*) wy, sum(x*vz)/count(*) uz, sum(y*vz)/count(*) wz from tr),
 th as (select k, s, t.axis, case when k = 1 then u / a else (u*(d+s) - b*w) / (a*(d+s) - b*b) end p, case when k = 1 then 0 else (a*w - b*u) / (a*(d+s) - b*b) end q from g, m, lateral (select unnest([1, 2, 3]) axis, unnest([ux, uy, uz]) u, unnest([wx, wy, wz]) w) t),
 e as (select k, s, axis, sum((p*x + q*y - case axis when 1 then vx when 2 then vy else vz end)**2) e, sum(case axis when 1 then vx*vx when 2 then vy*vy else vz*vz end) t from th, va group by all)
 select k n_basis, s strength, round(sqrt(sum(e) / sum(t)), 6) nrmse from e group by all""")
def cartesian_grid(spark, d):
    p = points(spark, d).withColumn("design", F.array("x", "y"))
    return rounded(L.vector_scores(p.where("id % 4 = 0"), "design", ["vx", "vy", "vz"], L.vector_coefficients(p.where("id % 4 <> 0"), "design", ["vx", "vy", "vz"], np.array([0.0, 1.0]), [1, 2], [0.01, 4.0], [1.0], ridge=0.0))
                   .select("n_basis", "strength", "nrmse"))


@query(f"""with {POINTS}, m as (select count(*) n, sum(x*x) a, sum(x*y) b, sum(y*y) d, sum(x*vx) u, sum(y*vx) v from points where id % 4 <> 0), c as (select n, (u*d - b*v) / (a*d - b*b) p, (a*v - b*u) / (a*d - b*b) q from m)
 select 2 "rank", round(any_value(p), 6) theta0, round(any_value(q), 6) theta1, 0.0::double twice, round(sqrt(sum((p*x + q*y - vx)**2)), 6) residual from c, points where id % 4 <> 0""")
def unconstrained_fit(spark, d):
    """Least squares without penalty on a design whose third column repeats the first, which the least of all solutions shares out."""
    rows = points(spark, d).where("id % 4 <> 0").withColumn("design", F.array("x", "y", "x"))
    fit = L.least_squares(rows, "design", ["vx"])
    c = fit["theta"][:, 0]
    return spark.createDataFrame([(fit["rank"], round(float(c[0] + c[2]), 6), round(float(c[1]), 6), round(abs(float(c[0] - c[2])), 6) + 0.0, round(float(fit["residual"][0]), 6))],
                                 "rank int, theta0 double, theta1 double, twice double, residual double")


@query(f"""with {POINTS}, o as (select *, row_number() over (order by (id * 1103515245 + 3 * 12345) % 2147483648, id) - 1 k, count(*) over () n from points),
 sp as (select *, case when k < round_even(0.6 * n, 0) then 'train' when k < round_even(0.6 * n, 0) + round_even(0.2 * n, 0) then 'validation' else 'test' end s from o),
 m as (select sum(x*x)/count(*) a, sum(x*y)/count(*) b, sum(y*y)/count(*) d, sum(x*vx)/count(*) u, sum(y*vx)/count(*) v from sp where s = 'train'),
 g as (select n_basis, strength, power from (select unnest([1, 2]) n_basis), (select unnest([0.0001, 0.01, 1.0]::double[]) strength), (select unnest([1.0, 2.0]::double[]) power)),
 th as (select n_basis, strength, power, case when n_basis = 1 then u / a else (u*(d + strength) - b*v) / (a*(d + strength) - b*b) end p, case when n_basis = 1 then 0 else (a*v - b*u) / (a*(d + strength) - b*b) end q from g, m)
 select n_basis, strength, power, round(sqrt(sum((p*x + q*y - vx)**2) / sum(vx*vx)), 6) nrmse from th, sp where s = 'validation' group by all""")
def ridge_grid_scores(spark, d):
    rows = points(spark, d).withColumn("design", F.array("x", "y"))
    part = cut(T.split(rows, "id", 3, 0.6, 0.2))
    g, r, _ = L.gram(part.where("split = 'train'"), "design", "vx")
    grid_ = L.grid_coefficients(g, r, np.array([0.0, 1.0]), [1, 2], [1e-4, 1e-2, 1.0], [1.0, 2.0])
    return rounded(L.grid_scores(part.where("split = 'validation'"), "design", "vx", grid_).select("n_basis", "strength", "power", "nrmse"))


@query(f"""with {POINTS}, d as (select id, unnest([x, y, z]) a, unnest([y, z, x]) b, unnest([vx, vy, vz]) t from points), m as (select sum(a*a)/count(*) a, sum(a*b)/count(*) b, sum(b*b)/count(*) d, sum(a*t)/count(*) u, sum(b*t)/count(*) v from d where id % 4 <> 0),
 g as (select n_basis, strength from (select unnest([1, 2]) n_basis), (select unnest([0.01, 1.0]::double[]) strength)),
 th as (select n_basis, strength, case when n_basis = 1 then u / a else (u*(d + strength) - b*v) / (a*(d + strength) - b*b) end p, case when n_basis = 1 then 0 else (a*v - b*u) / (a*(d + strength) - b*b) end q from g, m)
 select n_basis, strength, round(sqrt(sum((p*d.a + q*d.b - t)**2) / sum(t*t)), 6) nrmse from th, d where id % 4 = 0 group by all""")
def vector_grid(spark, d):
    s = lambda *c: F.struct(*[F.col(k).alias(a) for k, a in zip(c, "xyz")])
    p = points(spark, d).withColumn("g", F.array(s("x", "y", "z"), s("y", "z", "x")))
    return rounded(P.vector_grid(p.where("id % 4 <> 0"), p.where("id % 4 = 0"), "id", "g", ["vx", "vy", "vz"], np.array([0.0, 1.0]), [1, 2], [0.01, 1.0], [1.0]).select("n_basis", "strength", "nrmse"))
