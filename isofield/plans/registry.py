"""Queries over the standard tables, each with the SQL that another engine can check it by.

The adapters below give every operator a realistic input: candidate grids and score curves from line items, point
catalogs from embeddings, survey objects from customers. Doubles are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isofield.functions import columns as C
from isofield.operators import graph as G
from isofield.operators import potential as P
from isofield.operators import regression as L
from isofield.operators import relational as R
from isofield.operators import selectors as S
from isofield.operators import summaries as M
from isofield.operators import weights as T
from isofield.sources.shared import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


# Adapters.

def curve(spark, d):
    """Scores by group, basis size and seed."""
    li = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy(F.col("l_returnflag").alias("grp"), F.col("p_size").alias("n_basis"), F.col("l_linenumber").alias("seed")) \
        .agg(F.round(F.avg("l_discount") + F.try_divide(F.lit(1.0), F.first("p_size").cast("double")), 9).alias("score"))


CURVE = """curve as (select l_returnflag grp, p_size n_basis, l_linenumber seed, round(avg(l_discount) + 1.0::double / max(p_size), 9) score
 from lineitem join part on l_partkey = p_partkey group by l_returnflag, p_size, l_linenumber)"""


def grid(spark, d):
    """Candidate scores by seed, loss, basis size, strength and power."""
    li = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy(F.col("l_linenumber").alias("seed"), F.col("l_returnflag").alias("loss_name"), F.col("p_size").alias("n_basis"),
                      F.round(F.col("l_discount") * 100).cast("int").alias("lam"), F.col("l_linestatus").alias("pw")).agg(F.round(F.avg("l_tax"), 9).alias("score"))


GRID = """grid as (select l_linenumber seed, l_returnflag loss_name, p_size n_basis, cast(round(l_discount * 100) as int) lam, l_linestatus pw, round(avg(l_tax), 9) score
 from lineitem join part on l_partkey = p_partkey group by all)"""


def runs(spark, d):
    li = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.groupBy(F.col("l_linenumber").alias("seed"), F.col("l_returnflag").alias("model"), F.col("o_orderpriority").alias("scale")).agg(
        F.round(F.avg("l_extendedprice") / 1000, 9).alias("score"), F.count(F.lit(1)).alias("n"))


RUNS = """runs as (select l_linenumber seed, l_returnflag model, o_orderpriority scale, round(avg(l_extendedprice) / 1000, 9) score, count(*) n
 from lineitem join orders on l_orderkey = o_orderkey group by all)"""


def pairs(spark, d):
    li = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.select((F.col("l_extendedprice") / 1000).alias("t"), (F.col("l_quantity") * F.col("p_retailprice") / 1000).alias("p"),
                     (F.lit(0.05) + F.col("l_discount")).alias("w"), (F.col("l_suppkey") % 8).cast("int").alias("region"), F.col("l_tax").alias("tax"))


PAIRS = """pairs as (select l_extendedprice / 1000 t, l_quantity * p_retailprice / 1000 p, 0.05::double + l_discount w, cast(l_suppkey % 8 as int) region, l_tax tax
 from lineitem join part on l_partkey = p_partkey)"""


def points(spark, d):
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *[at(k).alias(c) for k, c in enumerate(("x", "y", "z", "vx", "vy", "vz"))], F.col("label").alias("region"))


POINTS = """points as (select vec_id id, embedding[1]::double x, embedding[2]::double y, embedding[3]::double z, embedding[4]::double vx,
 embedding[5]::double vy, embedding[6]::double vz, label region from embeddings)"""
EDGES = POINTS + """, edges as (select src, dst, dist, rank from (select a.id src, b.id dst, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) dist,
 row_number() over (partition by a.id order by sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), b.id) rank from points a join points b on a.id <> b.id) where rank <= 8),
 rho as (select src, dist rho from edges where rank = 4),
 half as (select e.src, e.dst, exp(-(e.dist*e.dist)/(r.rho*s.rho)) w from edges e join rho r on e.src = r.src join rho s on e.dst = s.src),
 weights as (select src, dst, max(w) w from (select * from half union all select dst, src, w from half) group by all union all select id, id, 1.0 from points),
 trans as (select src, dst, w / sum(w) over (partition by src) p from weights)"""


def survey(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 8).cast("int").alias("region"), (1 + F.abs("c_acctbal") / 100).alias("dist"),
                                             (10 + F.lit(0.3) * (F.col("c_nationkey") % 8)).alias("m_lim"))


SURVEY = """survey as (select c_custkey id, cast(c_nationkey % 8 as int) region, 1 + abs(c_acctbal) / 100 dist, 10 + 0.3::double * (c_nationkey % 8) m_lim from customer)"""


def edges8(spark, d):
    p = points(spark, d)
    return G.knn(p, p, 8, True)


# Selection of a basis size.

@query(f"""with {CURVE}, m as (select grp, n_basis, avg(score) mean, coalesce(stddev_samp(score), 0) / sqrt(count(*)) sem from curve group by all),
 b as (select grp, n_basis best, mean + sem bound from (select *, row_number() over (partition by grp order by mean, n_basis) k from m) where k = 1),
 o as (select m.grp, min(n_basis) one_se from m join b on m.grp = b.grp and m.mean <= b.bound group by 1),
 g as (select grp, n_basis, (lag(mean) over w - mean) / lag(mean) over w imp from m window w as (partition by grp order by n_basis)),
 f as (select grp, n_basis, lead(imp, 1) over w < 0.02 and lead(imp, 2) over w < 0.02 flat from g window w as (partition by grp order by n_basis)),
 p as (select grp, min(n_basis) filter (where flat) plateau from f group by 1), x as (select grp, max(n_basis) largest from m group by 1)
 select b.grp, best, one_se, coalesce(plateau, -1) plateau, greatest(one_se, coalesce(plateau, one_se)) practical, largest,
  plateau is not null and greatest(one_se, coalesce(plateau, one_se)) < largest converged from b join o using (grp) join p using (grp) join x using (grp)""")
def capacity_decision(spark, d):
    return S.capacity_decision(curve(spark, d), ["grp"], "n_basis", "score").fillna(-1, ["plateau"])


@query(f"""with {CURVE} select grp, n_basis, count(score) n, round(avg(score), 6) mean, round(coalesce(stddev_samp(score), 0), 6) std,
 round(coalesce(stddev_samp(score), 0) / sqrt(count(score)), 6) sem, round(min(score), 6) min, round(quantile_cont(score, 0.5), 6) median, round(max(score), 6) max from curve group by all""")
def finite_summary(spark, d):
    return rounded(M.finite_summary(curve(spark, d), ["grp", "n_basis"], "score"))


@query(f"""with {CURVE}, m as (select grp, n_basis, avg(score) score from curve group by all)
 select grp, n_basis, coalesce(lag(n_basis) over w, -1) previous_size, round((lag(score) over w - score) / lag(score) over w, 6) improvement from m window w as (partition by grp order by n_basis)""")
def relative_improvement(spark, d):
    m = curve(spark, d).groupBy("grp", "n_basis").agg(F.avg("score").alias("score"))
    return rounded(S.relative_improvement(m, ["grp"], "n_basis", "score").select("grp", "n_basis", "previous_size", "improvement").fillna(-1, ["previous_size"]))


def _plateau_sql(least: int) -> str:
    return f"""with {CURVE}, m as (select grp, n_basis, avg(score) mean from curve group by all), k as (select distinct grp from m),
 g as (select grp, n_basis, (lag(mean) over w - mean) / lag(mean) over w imp from m where n_basis >= {least} window w as (partition by grp order by n_basis)),
 f as (select grp, n_basis, lead(imp, 1) over w < 0.02 and lead(imp, 2) over w < 0.02 flat from g window w as (partition by grp order by n_basis))
 select k.grp, coalesce(plateau, -1) plateau from k left join (select grp, min(n_basis) filter (where flat) plateau from f group by 1) using (grp)"""


@query(_plateau_sql(12))
def plateau_floor(spark, d):
    m = curve(spark, d).groupBy("grp", "n_basis").agg(F.avg("score").alias("mean"))
    return S.plateau(m, ["grp"], "n_basis", "mean", least=12).fillna(-1, ["plateau"])


@query(_plateau_sql(0))
def plateau_nofloor(spark, d):
    m = curve(spark, d).groupBy("grp", "n_basis").agg(F.avg("score").alias("mean"))
    return S.plateau(m, ["grp"], "n_basis", "mean").fillna(-1, ["plateau"])


@query(f"""with {CURVE}, m as (select grp, n_basis, avg(score) mean, coalesce(stddev_samp(score), 0) / sqrt(count(*)) sem from curve group by all),
 b as (select grp, n_basis best, mean + sem bound from (select *, row_number() over (partition by grp order by mean, n_basis) k from m) where k = 1)
 select b.grp, any_value(best) best, round(any_value(bound), 6) bound, min(n_basis) one_se from m join b on m.grp = b.grp and m.mean <= b.bound group by 1""")
def one_se(spark, d):
    return rounded(S.one_standard_error(M.finite_summary(curve(spark, d), ["grp", "n_basis"], "score"), ["grp"], "n_basis", "mean", "sem"))


@query(f"""with {GRID} select seed, loss_name, n_basis, lam, pw, score from (select *, row_number() over (partition by seed, loss_name order by score, n_basis, lam, pw) k from grid) where k = 1""")
def argmin_tiebreak(spark, d):
    return R.argmin(grid(spark, d), ["seed", "loss_name"], "score", ["n_basis", "lam", "pw"])


@query(f"""with {GRID}, a as (select * from (select *, row_number() over (partition by seed, loss_name order by score, n_basis, lam, pw) k from grid) where k = 1),
 b as (select * from (select *, row_number() over (partition by seed, loss_name order by score, n_basis, lam, pw) k from grid where n_basis <= 25) where k = 1)
 select count(*) compared, count_if(a.n_basis = b.n_basis and a.lam = b.lam and a.pw = b.pw) same, round(avg(a.n_basis - b.n_basis), 6) mean_size_gap from a join b on a.seed = b.seed and a.loss_name = b.loss_name""")
def selector_agreement(spark, d):
    g, keys, ties = grid(spark, d), ["seed", "loss_name"], ["n_basis", "lam", "pw"]
    return rounded(S.agreement(R.argmin(g, keys, "score", ties), R.argmin(g.where("n_basis <= 25"), keys, "score", ties), keys, ties, "n_basis"))


@query(f"""with {GRID}, a as (select * from (select *, row_number() over (partition by seed, loss_name order by score, n_basis, lam, pw) k from grid) where k = 1),
 s as (select loss_name, seed, avg(case when n_basis = 50 then 1.0 else 0.0 end) share from a group by all) select loss_name, round(avg(share), 6) share_at_largest, count(*) seeds from s group by 1""")
def share_at_largest(spark, d):
    return rounded(S.at_largest(R.argmin(grid(spark, d), ["seed", "loss_name"], "score", ["n_basis", "lam", "pw"]), ["loss_name"], "seed", "n_basis", 50))


@query(f"""with {RUNS} select model, scale, seed, round(row_number() over (partition by model, scale order by score, seed) / count(*) over (partition by model, scale), 6) cdf from runs""")
def empirical_cdf(spark, d):
    return rounded(S.empirical_cdf(runs(spark, d), ["model", "scale"], "score", "seed").select("model", "scale", "seed", "cdf"))


@query(f"""with {CURVE}, m as (select grp, n_basis, avg(score) y from curve group by all), s as (select *, coalesce((y + lag(y) over w) / 2 * (n_basis - lag(n_basis) over w), 0) step from m window w as (partition by grp order by n_basis))
 select grp, n_basis, round(sum(step) over (partition by grp order by n_basis), 6) integral from s""")
def cumulative_trapezoid(spark, d):
    m = curve(spark, d).groupBy("grp", "n_basis").agg(F.avg("score").alias("y"))
    return rounded(S.cumulative_trapezoid(m, ["grp"], "n_basis", "y").select("grp", "n_basis", "integral"))


# Relational core.

@query("""select c_custkey id, c_name, round(c_acctbal - 100, 6) centred, case when c_acctbal < 0 then 'low' when c_acctbal < 5000 then 'mid' else 'high' end band
 from customer where c_acctbal between -500 and 9000 and c_mktsegment in ('BUILDING', 'HOUSEHOLD') and c_name like 'Customer%' and regexp_full_match(c_name, 'Customer#[0-9]+')""")
def filter_project(spark, d):
    c = read(spark, d, "customer").where(F.col("c_acctbal").between(-500, 9000) & F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD") & F.col("c_name").startswith("Customer") & F.col("c_name").rlike("^Customer#[0-9]+$"))
    band = F.when(F.col("c_acctbal") < 0, "low").when(F.col("c_acctbal") < 5000, "mid").otherwise("high")
    return c.select(F.col("c_custkey").alias("id"), "c_name", F.round(F.col("c_acctbal") - 100, 6).alias("centred"), band.alias("band"))


@query("select l_orderkey, l_linenumber from lineitem where abs(l_discount - 0.05) <= 1e-8 + 1e-5 * 0.05 and l_quantity = 10")
def tolerant_equality(spark, d):
    return read(spark, d, "lineitem").where(C.close(F.col("l_discount"), F.lit(0.05)) & (F.col("l_quantity") == 10)).select("l_orderkey", "l_linenumber")


@query(f"""with {RUNS}, i as (select model, scale, seed, avg(score) score from runs group by all)
 select model, scale, count(*) n, round(avg(score), 6) mean, round(coalesce(stddev_samp(score), 0), 6) std, round(coalesce(stddev_samp(score), 0) / sqrt(count(*)), 6) sem, round(min(score), 6) min,
 round(quantile_cont(score, 0.5), 6) median, round(max(score), 6) max from i group by all""")
def nested_seed_aggregate(spark, d):
    return rounded(M.nested_summary(runs(spark, d), ["model", "scale"], "seed", "score"))


@query(f"""with {RUNS} select model, round(avg(score), 6) mean_score, count(distinct seed) seeds, count_if(score < 50) wins, round(avg(case when score < 50 then 1.0 else 0.0 end), 6) win_share from runs group by 1""")
def named_agg_wins(spark, d):
    win = F.col("score") < 50
    return rounded(runs(spark, d).groupBy("model").agg(F.avg("score").alias("mean_score"), F.countDistinct("seed").alias("seeds"), F.count_if(win).alias("wins"), F.avg(win.cast("double")).alias("win_share")))


@query(f"""with {RUNS} select a.seed, a.model, a.scale, round(a.score - b.score, 6) delta from runs a left join (select * from runs where model = 'A') b on a.seed = b.seed and a.scale = b.scale""")
def left_baseline_delta(spark, d):
    r = runs(spark, d)
    base = r.where("model = 'A'").select("seed", "scale", F.col("score").alias("base"))
    return r.join(base, ["seed", "scale"], "left").select("seed", "model", "scale", F.round(F.col("score") - F.col("base"), 6).alias("delta"))


@query("select o_orderkey id from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def anti_join_pool(spark, d):
    taken = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(taken, "id", "left_anti")


@query("select o_orderkey id from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 49)")
def semi_join(spark, d):
    kept = read(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("id"))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(kept, "id", "left_semi")


@query("select s_suppkey id, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def broadcast_region(spark, d):
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    s = read(spark, d, "supplier")
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("id"), "n_name", "r_name")


@query("select l_suppkey id from lineitem where l_tax = 0.08 union select l_suppkey from lineitem where l_discount = 0.1")
def union_distinct_ids(spark, d):
    li = read(spark, d, "lineitem")
    return li.where("l_tax = 0.08D").select(F.col("l_suppkey").alias("id")).union(li.where("l_discount = 0.1D").select("l_suppkey")).distinct()


@query(f"with {RUNS} select seed, model, scale, score, n from runs where model <> 'R' union all select seed, model, scale, round(score * 2, 6), n from runs where model = 'R'")
def upsert_slice(spark, d):
    r = runs(spark, d)
    return R.upsert(r, r.where("model = 'R'").withColumn("score", F.round(F.col("score") * 2, 6)), ["model"])


@query(f"""with {RUNS} select seed, scale, round(max(score) filter (where model = 'A'), 6) "A", round(max(score) filter (where model = 'N'), 6) "N", round(max(score) filter (where model = 'R'), 6) "R" from runs group by all""")
def pivot_roles(spark, d):
    return rounded(R.pivot_exact(runs(spark, d), ["seed", "scale"], "model", ["A", "N", "R"], "score"))


@query(f"""with {SURVEY} select 'all' subset, count(*) n from survey union all select 'near', count_if(dist < 30) from survey union all select 'far_region_0', count_if(dist >= 30 and region = 0) from survey
 union all select 'inside_q90', count(*) from survey, (select quantile_cont(dist, 0.9) q from survey) where dist <= q""")
def unpivot_support_counts(spark, d):
    s = survey(spark, d)
    q = R.quantiles(s.select("dist"), [], "dist", [0.9]).select(F.get("quantiles", F.lit(0)).alias("q"))
    masks = {"all": F.lit(True), "near": F.col("dist") < 30, "far_region_0": (F.col("dist") >= 30) & (F.col("region") == 0), "inside_q90": F.col("dist") <= F.col("q")}
    return R.subset_counts(s.crossJoin(F.broadcast(q)), masks)


@query(f"with {GRID} select loss_name, pw, lam, count(*) count from grid group by all")
def frequency_table(spark, d):
    return R.frequency(grid(spark, d), ["loss_name"], ["pw", "lam"])


@query(f"""with {RUNS}, s as (select scale, avg(score) score from runs group by 1), l as (select * from (values (0, '5-LOW'), (1, '1-URGENT'), (2, 'ABSENT')) t(place, scale))
 select place, l.scale, round(score, 6) score from l left join s on l.scale = s.scale""")
def enum_order(spark, d):
    s = runs(spark, d).groupBy("scale").agg(F.avg("score").alias("score"))
    return rounded(R.in_label_order(s, "scale", ["5-LOW", "1-URGENT", "ABSENT"]))


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) k from orders) where k = 1")
def dedupe_last(spark, d):
    return R.keep_one(read(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""select s_nationkey, list_sort(list_filter(range(8), lambda m: not list_contains(list(distinct s_suppkey % 8), m)))::int[] missing from supplier group by 1""")
def missing_members(spark, d):
    s = read(spark, d, "supplier").withColumn("member", F.col("s_suppkey") % 8)
    return R.missing_members(s, "s_nationkey", "member", list(range(8)))


@query(f"""with {GRID}, o as (select * from grid where n_basis <= 30) select count(*) common_rows, round(max(abs(g.score - (o.score + 0.001))), 6) max_abs_score, round(avg(g.score - (o.score + 0.001)), 6) mean_score
 from grid g join o using (seed, loss_name, n_basis, lam, pw)""")
def continuity_audit(spark, d):
    g = grid(spark, d)
    return rounded(R.audit(g, g.where("n_basis <= 30").withColumn("score", F.col("score") + 0.001), ["seed", "loss_name", "n_basis", "lam", "pw"], ["score"]))


@query(f"""with {GRID} select b.n_basis, s.seed from (select distinct n_basis from grid) b, (select distinct seed from grid) s where not exists (select 1 from grid g where g.n_basis = b.n_basis and g.seed = s.seed and g.lam = 0 and g.loss_name = 'A')""")
def missing_checkpoint_blocks(spark, d):
    g = grid(spark, d)
    expected = g.select("n_basis").distinct().crossJoin(g.select("seed").distinct())
    return R.missing_blocks(expected, g.where("lam = 0 and loss_name = 'A'"), ["n_basis", "seed"])


@query(f"with {GRID} select seed, loss_name, n_basis, lam, pw, row_number() over (order by seed, loss_name, n_basis, lam, pw) - 1 candidate_id from grid")
def candidate_numbers(spark, d):
    return R.numbered(grid(spark, d).drop("score"), ["seed", "loss_name", "n_basis", "lam", "pw"])


@query("""select count(*) n, cast(sum(cast('0x' || substr(md5(concat_ws('|', o_orderkey::varchar, o_custkey::varchar, o_orderstatus, cast(round(o_totalprice * 100) as bigint)::varchar, o_orderpriority)), 1, 15) as bigint)::hugeint) as varchar) digest from orders""")
def table_digest(spark, d):
    o = read(spark, d, "orders")
    return R.text_digest(o, [F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.round(F.col("o_totalprice") * 100).cast("long"), F.col("o_orderpriority")]).select("n", F.col("digest").cast("string").alias("digest"))


@query("select r, coalesce(n, 0) n from (select unnest(range(0, 30)) r) left join (select s_nationkey r, count(*) n from supplier group by 1) using (r)")
def region_counts(spark, d):
    return R.counts_of(read(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("r")), "r", spark.range(30).withColumnRenamed("id", "r"))


# Scores.

@query(f"with {PAIRS} select region, round(sqrt(sum(w * (p - t) * (p - t)) / sum(w * t * t)), 6) nrmse, round(sum(w * t) / sum(w), 6) mean_t, round(sum(w) * sum(w) / sum(w * w), 3) effective from pairs group by 1")
def weighted_nrmse(spark, d):
    t, p, w = F.col("t"), F.col("p"), F.col("w")
    return pairs(spark, d).groupBy("region").agg(F.round(M.nrmse(t, p, w), 6).alias("nrmse"), F.round(M.weighted_mean(t, w), 6).alias("mean_t"), F.round(M.effective_size(w), 3).alias("effective"))


VECTOR = f"""{POINTS}, v as (select region, x, y, z, vx, vy, vz, sqrt(x*x+y*y+z*z) lt, sqrt(vx*vx+vy*vy+vz*vz) lp, (vx-x)*(vx-x)+(vy-y)*(vy-y)+(vz-z)*(vz-z) e2,
 degrees(acos(greatest(-1, least(1, (x*vx+y*vy+z*vz) / nullif(sqrt(x*x+y*y+z*z) * sqrt(vx*vx+vy*vy+vz*vz), 0))))) ang from points)"""


@query(f"""with {VECTOR} select region, count(*) n, round(sqrt(avg(e2)), 6) rmse_3d, round(sqrt(sum(e2) / sum(lt*lt)), 6) nrmse, round(sqrt(avg((vx-x)*(vx-x))), 6) rmse_x, round(sqrt(avg((vy-y)*(vy-y))), 6) rmse_y,
 round(sqrt(avg((vz-z)*(vz-z))), 6) rmse_z, round(corr(x, vx), 6) corr_x, round(corr(y, vy), 6) corr_y, round(corr(z, vz), 6) corr_z, round(quantile_cont(ang, 0.5), 6) angle_median, round(quantile_cont(ang, 0.9), 6) angle_p90,
 round(quantile_cont(abs((lp - lt) / nullif(lt, 0)), 0.5), 6) speed_error_median, round(sqrt(pow(avg(vx-x), 2) + pow(avg(vy-y), 2) + pow(avg(vz-z), 2)), 6) mean_residual from v group by 1""")
def vector_metrics(spark, d):
    return rounded(M.vector_metrics(points(spark, d), ["region"], ["x", "y", "z"], ["vx", "vy", "vz"]))


@query(f"""with {POINTS}, q as (select *, (x*vx+y*vy+z*vz)/sqrt(x*x+y*y+z*z) rt, (x*vy+y*vz+z*vx)/sqrt(x*x+y*y+z*z) rp, (vy-vx)*(vy-vx)+(vz-vy)*(vz-vy)+(vx-vz)*(vx-vz) e2, vx*vx+vy*vy+vz*vz t2 from points)
 select region, count(*) n, round(sqrt(sum((rp-rt)*(rp-rt))/sum(rt*rt)), 6) nrmse_radial, round(sqrt(sum(e2-(rp-rt)*(rp-rt))/sum(t2-rt*rt)), 6) nrmse_tangential, round(sqrt(sum(e2)/sum(t2)), 6) nrmse_3d,
 round(corr(rt, rp), 6) radial_corr, round(avg(rp-rt), 6) radial_bias from q group by 1""")
def radial_tangential(spark, d):
    p = points(spark, d).withColumns({"px": F.col("vy"), "py": F.col("vz"), "pz": F.col("vx")})
    return rounded(M.radial_metrics(p, ["region"], ["x", "y", "z"], ["vx", "vy", "vz"], ["px", "py", "pz"]))


@query(f"with {PAIRS} select region, round(regr_slope(p, t), 6) slope, round(regr_intercept(p, t), 4) intercept, round(sum(t * p) / sum(t * t), 6) origin_slope from pairs group by 1")
def calibration_lines(spark, d):
    return M.calibration(pairs(spark, d), ["region"], "t", "p").select("region", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("origin_slope", 6).alias("origin_slope"))


@query(f"""with {PAIRS}, g as (select region, t, sum(w) w from pairs where w > 0 group by all), c as (select region, t, sum(w) over (partition by region order by t) / sum(w) over (partition by region) c from g),
 l as (select region, t, c, lag(t) over k t0, lag(c) over k c0 from c window k as (partition by region order by t))
 select region, round(coalesce(t0 + (t - t0) * (0.9 - c0) / (c - c0), t), 5) q90 from l where c >= 0.9 and (c0 is null or c0 < 0.9)""")
def weighted_quantile(spark, d):
    return rounded(M.weighted_quantile(pairs(spark, d), ["region"], "t", "w", 0.9, "q90"), 5)


@query(f"""with {PAIRS}, e as (select list_sort(list_distinct(quantile_cont(t, [0, .125, .25, .375, .5, .625, .75, .875, 1]))) e from pairs),
 b as (select least(len(list_filter(e, lambda v: v <= t)) - 1, len(e) - 2) bin, t, p from pairs, e) select bin, count(*) n, round(avg(t), 6) centre, round(avg(p), 6) mean from b group by 1 having count(*) >= 5""")
def quantile_bins(spark, d):
    return M.quantile_bins(pairs(spark, d), "t", "p", 8).select("bin", "n", F.round("centre", 6).alias("centre"), F.round("mean", 6).alias("mean"))


@query(f"""with {PAIRS}, r as (select case when region = 3 then 2 else region end region, sqrt(sum((p-t)*(p-t))/sum(t*t)) v, count(*) n from pairs group by 1)
 select 'all' model, round(avg(v), 6) mean, round(stddev_pop(v), 6) std, round(max(v), 6) worst, round(min(v), 6) best, round(max(v)-min(v), 6) "range", '3' missing from r""")
def octant_summary(spark, d):
    p = pairs(spark, d).withColumn("region", F.when(F.col("region") == 3, 2).otherwise(F.col("region"))).withColumn("model", F.lit("all"))  # region 3 has no rows then
    return rounded(M.octant_summary(p, ["model"], "region", M.nrmse(F.col("t"), F.col("p"))))


@query(f"with {PAIRS} select region, round(avg(case when abs(t - p) <= 5 then 1.0 else 0.0 end), 6) c68, round(avg(case when abs(t - p) <= 1.95996 * 5 then 1.0 else 0.0 end), 6) c95 from pairs group by 1")
def coverage_68_95(spark, d):
    c = lambda z: M.coverage(F.col("t"), F.col("p"), F.lit(25.0), z)
    return rounded(pairs(spark, d).groupBy("region").agg(c(1.0).alias("c68"), c(1.95996).alias("c95")))


@query(f"""with {PAIRS} select subset, count(*) n, round(sqrt(sum((p-t)*(p-t))/sum(t*t)), 6) score from (select 'all' subset, t, p from pairs union all select 'small', t, p from pairs where t < 5 union all select 'none', t, p from pairs where t < 0) group by 1 having count(*) >= 5""")
def subset_scores(spark, d):
    masks = {"all": F.lit(True), "small": F.col("t") < 5, "none": F.col("t") < 0}
    return rounded(M.subset_scores(pairs(spark, d), masks, M.nrmse(F.col("t"), F.col("p")), 5))


@query(f"with {SURVEY} select region, count(*) n, round(max(m_lim), 6) m_lim, round(min(dist), 6) dist_min, round(quantile_cont(dist, 0.5), 6) dist_median, round(max(dist), 6) dist_max from survey group by 1")
def selection_audit(spark, d):
    s = survey(spark, d)
    sums = s.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("m_lim").alias("m_lim"), F.min("dist").alias("dist_min"), F.max("dist").alias("dist_max"))
    medians = R.quantiles(s.select("region", "dist"), ["region"], "dist", [0.5]).select("region", F.get("quantiles", F.lit(0)).alias("dist_median"))
    return rounded(sums.join(medians, "region"))


# Weights and splits.

PROBABILITY = f"""{SURVEY}, lim as (select *, m_lim - 5 * log10(dist) - 25 m from survey), prob as (select id, region, dist, case when m <= -24.0 then 0.0 when m < -20.0 then (m + 24.0) * (0.4 / 4.0) when m < -14.0 then 0.4 + (m + 20.0) * (0.6 / 6.0) else 1.0 end pr from lim)"""


def probability(spark, d):
    s = survey(spark, d)
    return s.withColumn("pr", T.selection_probability(T.limit_magnitude(F.col("m_lim"), F.col("dist")), [-24.0, -20.0, -14.0], [0.0, 0.4, 1.0]))


@query(f"with {PROBABILITY} select id, round(pr, 6) pr from prob")
def selection_probability_interp(spark, d):
    return probability(spark, d).select("id", F.round("pr", 6).alias("pr"))


def _weights_sql(power: float) -> str:
    return f"""with {PROBABILITY}, raw as (select id, pow(greatest(pr, 1e-3), -{power}) r from prob), cap as (select least(50.0, quantile_cont(r, 0.995)) c from raw), capped as (select id, least(r, c) k from raw, cap)
 select id, round(k / (select avg(k) from capped), 6) weight from capped"""


@query(_weights_sql(1.0))
def capped_inverse_weights(spark, d):
    return rounded(T.inverse_weights(probability(spark, d), "pr").select("id", "weight"))


@query(_weights_sql(0.5))
def tempered_weights(spark, d):
    return rounded(T.inverse_weights(probability(spark, d), "pr", power=0.5).select("id", "weight"))


def _split_sql(by: str) -> str:
    return f"""with {SURVEY}, o as (select *, row_number() over ({by} order by (id * 1103515245 + 7 * 12345) % 2147483648, id) - 1 k, count(*) over ({by}) n from survey)
 select {'region, ' if by else ''}case when k < round_even(0.7 * n, 0) then 'train' when k < round_even(0.7 * n, 0) + round_even(0.15 * n, 0) then 'validation' else 'test' end split, count(*) n, sum(id)::bigint ids from o group by all"""


@query(_split_sql(""))
def hash_split_counts(spark, d):
    return T.split(survey(spark, d), "id", 7, 0.7, 0.15).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(_split_sql("partition by region"))
def stratified_split_counts(spark, d):
    return T.split(survey(spark, d), "id", 7, 0.7, 0.15, ["region"]).groupBy("region", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(f"""with {SURVEY}, r as (select *, 1 + 2.0 * pow(greatest(0, least(1, dist / 50)), 1.5) raw from survey) select id, round(raw / sqrt((select avg(raw * raw) from r where region < 6)), 6) profile from r""")
def profile_weights(spark, d):
    return rounded(T.error_profile(survey(spark, d), "dist", 50.0, 3.0, 1.5, F.col("region") < 6).select("id", "profile"))


# Paired comparison.

@query(f"with {RUNS} select a.seed, a.scale, round(a.score - b.score, 6) delta_score from runs a join runs b on a.seed = b.seed and a.scale = b.scale where a.model = 'A' and b.model = 'R'")
def paired_differences(spark, d):
    return rounded(S.paired(runs(spark, d), ["seed", "scale"], "model", "A", "R", ["score"]))


@query(f"""with {RUNS}, p as (select a.scale, a.score - b.score d from runs a join runs b on a.seed = b.seed and a.scale = b.scale where a.model = 'A' and b.model = 'R')
 select scale, count_if(d < 0) wins, count_if(d = 0) ties, count_if(d > 0) losses, round(avg(d), 6) mean_delta, round(coalesce(stddev_samp(d), 0), 6) std_delta from p group by 1""")
def paired_summary(spark, d):
    return rounded(S.sign_counts(S.paired(runs(spark, d), ["seed", "scale"], "model", "A", "R", ["score"]), ["scale"], "delta_score"))


@query(f"""with {RUNS}, p as (select a.scale, a.score - b.score d from runs a join runs b on a.seed = b.seed and a.scale = b.scale where a.model = 'A' and b.model = 'R'),
 c as (select scale, count_if(d < 0) wins, count_if(d > 0) losses from p group by 1)
 select scale, round(least(1.0, 2 * list_sum(list_transform(range(0, (least(wins, losses) + 1)::bigint), lambda j: factorial((wins + losses)::int)::double / (factorial(j::int)::double * factorial((wins + losses - j)::int)::double))) / pow(2, wins + losses)), 6) p_value from c""")
def sign_test(spark, d):
    c = S.sign_counts(S.paired(runs(spark, d), ["seed", "scale"], "model", "A", "R", ["score"]), ["scale"], "delta_score")
    return c.select("scale", F.round(S.sign_test(F.col("wins"), F.col("losses")), 6).alias("p_value"))


PAIRED = f"""{RUNS}, p as (select a.scale, a.seed, a.score - b.score d from runs a join runs b on a.seed = b.seed and a.scale = b.scale where a.model = 'A' and b.model = 'R')"""


def random_sql(seed: str, draw: str, id_: str) -> str:
    """columns.random_number() in SQL."""
    x = f"(({id_})::bigint % 2147483648 * {C.ID_FACTOR} + ({draw})::bigint % 2147483648 * {C.DRAW_FACTOR} + ({seed})::bigint % 2147483648 * {C.SEED_FACTOR}) % 2147483648"
    for shift, factor in zip((15, 12), C.MIX_FACTORS):
        x = f"list_transform([{x}], lambda u: (xor(u, u >> {shift}) * {factor}) % 2147483648)[1]"
    return f"list_transform([{x}], lambda u: xor(u, u >> 15))[1]"


@query(f"""with {PAIRED}, r as (select scale, d, row_number() over (partition by scale order by d, seed) - 1 k, count(*) over (partition by scale) n from p),
 s as (select scale, any_value(n) n, avg(d) mean from r group by 1), b as (select scale, n, unnest(range(1, 401)) draw from s), i as (select scale, n, draw, unnest(range(n)) place from b),
 j as (select scale, draw, {random_sql('0', 'draw', 'place')} % n k from i), m as (select j.scale, draw, avg(d) v from j join r on j.scale = r.scale and j.k = r.k group by all)
 select m.scale, any_value(n) n, round(any_value(mean), 6) mean, round(quantile_cont(v, 0.025), 6) low, round(quantile_cont(v, 0.975), 6) high, round(avg(case when v < 0 then 1.0 else 0.0 end), 6) share_negative
 from m join s on m.scale = s.scale group by 1""")
def bootstrap_interval(spark, d):
    return rounded(S.bootstrap_mean(S.paired(runs(spark, d), ["seed", "scale"], "model", "A", "R", ["score"]), ["scale"], "delta_score", ["seed"], 400))


@query(f"""with {PAIRED}, r as (select seed % 3 g, seed, d, row_number() over (partition by seed order by d, scale) - 1 k, count(*) over (partition by seed) n from p),
 o as (select g, seed, any_value(n) n, avg(d) own, row_number() over (partition by g order by seed) - 1 t, count(*) over (partition by g) turns from r group by g, seed),
 s as (select g, avg(own) mean, any_value(turns) turns from o group by 1), b as (select g, turns, unnest(range(1, 201)) draw from s), c as (select g, turns, draw, unnest(range(turns)) place from b),
 a as (select c.g, draw, place, o.seed, o.n from (select *, {random_sql('5', 'draw', 'place')} % turns t from c) c join o on c.g = o.g and c.t = o.t),
 i as (select *, unnest(range(n)) spot from a), j as (select *, {random_sql('6 + place', 'draw', 'spot')} % n k from i),
 m as (select g, draw, avg(v) v from (select j.g, draw, place, avg(d) v from j join r on j.seed = r.seed and j.k = r.k group by all) group by all)
 select m.g, round(any_value(mean), 6) mean, round(quantile_cont(v, 0.025), 6) low, round(quantile_cont(v, 0.975), 6) high from m join s on m.g = s.g group by 1""")
def hierarchical_bootstrap(spark, d):
    deltas = S.paired(runs(spark, d), ["seed", "scale"], "model", "A", "R", ["score"]).withColumn("g", F.col("seed") % 3)
    return rounded(S.hierarchical_bootstrap(deltas, ["g"], "seed", "delta_score", ["scale"], 200, 5))


# Graphs over points.

@query(f"with {EDGES} select src, dst, round(dist, 6) dist, rank from edges")
def knn_edges(spark, d):
    return rounded(edges8(spark, d))


def weights8(spark, d):
    e = edges8(spark, d)
    rho = G.bandwidth(e, 4)
    return e, rho, cut(G.kernel(e, rho))


@query(f"with {EDGES} select src, dst, round(w, 6) w from weights where w > 0")
def kernel_edges(spark, d):
    return rounded(weights8(spark, d)[2])


@query(f"with {EDGES} select src, dst, round(p, 6) p from trans where p > 0")
def markov_rows(spark, d):
    return rounded(G.markov(weights8(spark, d)[2]))


@query(f"""with {EDGES}, q as (select src id, sum(w) q from weights group by 1), k as (select src, dst, w / (a.q * b.q) w from weights join q a on src = a.id join q b on dst = b.id),
 d as (select src id, sum(w) d from k group by 1) select q.id, round(q, 6) q, round(d, 6) d, round(d / (select sum(d) from d), 9) pi from q join d using (id)""")
def stationary_measure(spark, d):
    mass = points(spark, d).select("id", F.lit(1.0).alias("w"))
    nodes = G.alpha_operator(weights8(spark, d)[2], mass, 1.0)[1]
    return nodes.select("id", F.round("q", 6).alias("q"), F.round("d", 6).alias("d"), F.round("pi", 9).alias("pi"))


METRIC = f"""{EDGES}, s as (select t.src, sum(p*x) mx, sum(p*y) my, sum(p*z) mz, sum(p*x*x) xx, sum(p*x*y) xy, sum(p*x*z) xz, sum(p*y*y) yy, sum(p*y*z) yz, sum(p*z*z) zz from trans t join points on dst = id group by 1),
 metric as (select s.src, (xx-mx*mx)/(2*rho*rho) g_xx, (xy-mx*my)/(2*rho*rho) g_xy, (xz-mx*mz)/(2*rho*rho) g_xz, (yy-my*my)/(2*rho*rho) g_yy, (yz-my*mz)/(2*rho*rho) g_yz, (zz-mz*mz)/(2*rho*rho) g_zz from s join rho on s.src = rho.src)"""


def metric8(spark, d):
    _, rho, w = weights8(spark, d)
    p = G.markov(w)
    at = points(spark, d).select("id", "x", "y", "z")
    return p, at, rho, G.local_metric(p, at, rho)


@query(f"with {METRIC} select src, round(g_xx, 6) g_xx, round(g_xy, 6) g_xy, round(g_xz, 6) g_xz, round(g_yy, 6) g_yy, round(g_yz, 6) g_yz, round(g_zz, 6) g_zz from metric")
def local_metric(spark, d):
    return rounded(metric8(spark, d)[3])


@query(f"""with {METRIC}, t as (select *, g_xx*(g_yy*g_zz-g_yz*g_yz) + g_xy*(g_xz*g_yz-g_xy*g_zz) + g_xz*(g_xy*g_yz-g_xz*g_yy) det from metric)
 select src, round((g_yy*g_zz-g_yz*g_yz)/det, 4) i_xx, round((g_xz*g_yz-g_xy*g_zz)/det, 4) i_xy, round((g_xy*g_yz-g_xz*g_yy)/det, 4) i_xz, round((g_xx*g_zz-g_xz*g_xz)/det, 4) i_yy,
 round((g_xy*g_xz-g_xx*g_yz)/det, 4) i_yz, round((g_xx*g_yy-g_xy*g_xy)/det, 4) i_zz from t""")
def local_metric_inverse(spark, d):
    return rounded(G.inverse_metric(metric8(spark, d)[3]).drop("condition", "clipped"), 4)


@query("select vec_id src, 2.0 d_x, -3.0 d_y, 0.5 d_z from embeddings")
def affine_gradient_check(spark, d):
    p, at, rho, metric = metric8(spark, d)
    f = at.select("id", (2 * F.col("x") - 3 * F.col("y") + F.lit(0.5) * F.col("z") + 7).alias("v"))
    return rounded(G.gradient(p, at, rho, f, metric), 5)


@query(f"""with {EDGES}, k as (select e.src, dist, vx, vy, vz, exp(-(dist/0.2)*(dist/0.2)) w from edges e join points on dst = id)
 select src, round(sum(w*vx)/sum(w), 6) vx, round(sum(w*vy)/sum(w), 6) vy, round(sum(w*vz)/sum(w), 6) vz, round(sum(w)*sum(w)/sum(w*w), 6) effective, round(min(dist), 6) nearest, round(max(dist), 6) farthest from k group by 1""")
def bulk_field_fixed(spark, d):
    return rounded(G.bulk_field(edges8(spark, d), points(spark, d).select("id", "vx", "vy", "vz"), 0.2, ["vx", "vy", "vz"]))


@query(f"""with {EDGES}, k as (select e.src, e.dist, vx, exp(-(e.dist/(1.5*b.dist))*(e.dist/(1.5*b.dist))) w from edges e join edges b on e.src = b.src and b.rank = 3 join points on e.dst = id)
 select src, round(sum(w*vx)/sum(w), 6) vx, round(sum(w)*sum(w)/sum(w*w), 6) effective, round(min(dist), 6) nearest, round(max(dist), 6) farthest from k group by 1""")
def bulk_field_adaptive(spark, d):
    return rounded(G.bulk_field(G.adaptive_width(edges8(spark, d), 3, 1.5), points(spark, d).select("id", "vx"), F.col("h"), ["vx"]))


@query(f"""with {EDGES}, c as (select unnest([4, 8]) k, unnest([2, 3]) r), g as (select c.k, m.f, e.src, sum(exp(-(e.dist/(m.f*b.dist))*(e.dist/(m.f*b.dist)))*p.vx)/sum(exp(-(e.dist/(m.f*b.dist))*(e.dist/(m.f*b.dist)))) est
  from c, (select unnest([1.0::double, 2.0]) f) m, edges e join edges b on e.src = b.src join points p on e.dst = p.id where e.rank <= c.k and b.rank = c.r group by all)
 select k, f, round(sqrt(sum((est-vx)*(est-vx))/sum(vx*vx)), 6) nrmse from g join points on src = id group by all order by sqrt(sum((est-vx)*(est-vx))/sum(vx*vx)), k, f limit 1""")
def local_kernel_grid_best(spark, d):
    e, v = edges8(spark, d), points(spark, d).select("id", "vx")
    truth = v.select(F.col("id").alias("src"), F.col("vx").alias("t"))
    parts = [G.bulk_field(G.adaptive_width(e, max(1, round(k * 3 / 8)), f).where(F.col("rank") <= k), v, F.col("h"), ["vx"]).join(truth, "src")
             .agg(M.nrmse(F.col("t"), F.col("vx")).alias("nrmse")).select(F.lit(k).alias("k"), F.lit(f).alias("f"), "nrmse") for k in (4, 8) for f in (1.0, 2.0)]
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    return rounded(scores.orderBy("nrmse", "k", "f").limit(1))


@query(f"""with {EDGES}, k as (select e.src, e.dst, (1 + e.dst % 3) * exp(-(dist*dist)/(a.rho*b.rho)) w from edges e join rho a on e.src = a.src join rho b on e.dst = b.src)
 select src, round(sum(p), 6) row_sum, round(max(p), 6) largest from (select src, w / sum(w) over (partition by src) p from k) group by 1""")
def nystrom_row_sums(spark, d):
    e = edges8(spark, d)
    rho = G.bandwidth(e, 4)
    mass = points(spark, d).select("id", (1 + F.col("id") % 3).cast("double").alias("w"))
    return rounded(G.nystrom(e, rho, rho, mass).groupBy("src").agg(F.sum("p").alias("row_sum"), F.max("p").alias("largest")))


@query(f"with {POINTS} select id, round(atan2(y, x), 6) lon, round(asin(z / sqrt(x*x+y*y+z*z)), 6) lat, (case when x >= 0 then 1 else 0 end + case when y >= 0 then 2 else 0 end + case when z >= 0 then 4 else 0 end)::int octant from points")
def sky_coordinates(spark, d):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    lon, lat = C.sky(x, y, z)
    return points(spark, d).select("id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"), C.octant(x, y, z).cast("int").alias("octant"))


# Regression.

@query(f"""with {PAIRS} select i, j, round(v, 6) v from (select 0 i, 0 j, sum(w)/sum(w) v from pairs union all select 0, 1, sum(w*t)/sum(w) from pairs union all select 1, 1, sum(w*t*t)/sum(w) from pairs
 union all select 0, 2, sum(w*tax)/sum(w) from pairs union all select 1, 2, sum(w*t*tax)/sum(w) from pairs union all select 2, 2, sum(w*tax*tax)/sum(w) from pairs)""")
def gram_matrix(spark, d):
    rows = pairs(spark, d).withColumn("design", F.array(F.lit(1.0), "t", "tax"))
    g, _, _ = L.gram(rows, "design", "p", F.col("w"))
    return spark.createDataFrame([(i, j, round(float(g[i, j]), 6)) for i in range(3) for j in range(i, 3)], "i int, j int, v double")


@query(f"""with {PAIRS}, m as (select sum(w*t)/sum(w) b, sum(w*t*t)/sum(w) + 0.1 c, sum(w*p)/sum(w) u, sum(w*t*p)/sum(w) v from pairs)
 select round((u*c - b*v)/(1.0*c - b*b), 4) theta0, round((v - b*u)/(c - b*b), 4) theta1 from m""")
def ridge_solution_small(spark, d):
    import numpy as np

    rows = pairs(spark, d).withColumn("design", F.array(F.lit(1.0), "t"))
    g, r, _ = L.gram(rows, "design", "p", F.col("w"))
    theta = L.solve(g, r, np.array([0.0, 1.0]), 0.1, 0.0)
    return spark.createDataFrame([tuple(round(float(v), 4) for v in theta)], "theta0 double, theta1 double")


@query()
def ridge_grid(spark, d):
    import numpy as np

    rows = points(spark, d).withColumn("design", F.array("x", "y", "z", F.col("x") * F.col("y"), F.col("y") * F.col("z"), F.col("x") * F.col("z")))
    train = T.split(rows, "id", 3, 0.6, 0.2)
    g, r, _ = L.gram(train.where("split = 'train'"), "design", "vx")
    grid_ = L.grid_coefficients(g, r, np.arange(6) / 2.0, [2, 3, 6], [1e-4, 1e-2, 1.0], [1.0, 2.0])
    return L.grid_scores(train.where("split = 'validation'"), "design", "vx", grid_).orderBy("nrmse", "n_basis", "strength", "power")


@query(f"with {PAIRS} select region, round(sqrt(sum((p-t)*(p-t)/(w*w))/sum(t*t/(w*w))), 6) profile_nrmse, round(sqrt(avg(pow((p-t)/(5*w), 2))), 5) residual, round(sum(pow((p-t)/(5*w), 2))/(count(*) - 2.5::double), 4) chi2 from pairs group by 1")
def profile_scores(spark, d):
    t, p, w = F.col("t"), F.col("p"), F.col("w")
    return pairs(spark, d).groupBy("region").agg(F.round(P.profile_nrmse(t, p, w), 6).alias("profile_nrmse"), F.round(P.standard_residual(t, p, 5 * w), 5).alias("residual"),
                                                 F.round(P.reduced_chi_square(t, p, 5 * w, 2.5), 4).alias("chi2"))


@query(f"with {POINTS} select id, round((x*vx+y*vy+z*vz)/sqrt(x*x+y*y+z*z), 6) a0, round((x*vy+y*vz+z*vx)/sqrt(x*x+y*y+z*z), 6) a1, round(2*vx-vy, 6) ux, round(2*vy-vz, 6) uy, round(2*vz-vx, 6) uz from points")
def potential_design(spark, d):
    s = lambda *c: F.struct(*[F.col(k).alias(a) for k, a in zip(c, "xyz")])
    p = points(spark, d).withColumn("g", F.array(s("vx", "vy", "vz"), s("vy", "vz", "vx")))
    a = P.radial_design([F.col(c) for c in "xyz"], F.col("g"))
    u = P.velocity(F.col("g"), [2.0, -1.0])
    return rounded(p.select("id", F.get(a, F.lit(0)).alias("a0"), F.get(a, F.lit(1)).alias("a1"), *[c.alias(n) for c, n in zip(u, ("ux", "uy", "uz"))]))


@query(f"with {POINTS} select id, greatest(-1, least(1, round(vx / (select quantile_cont(abs(vx), 0.99) from points), 6))) scaled from points")
def robust_scaled(spark, d):
    return rounded(P.robust_scaled(points(spark, d), "vx").select("id", "scaled"))


@query(f"with {POINTS} select id from (select id, row_number() over (order by x, id) - 1 k from points) where k % 7 = 0")
def every_seventh(spark, d):
    return P.thin(points(spark, d).select("id", "x"), ["x", "id"], 7).select("id")


_TIMES = " + ".join(f"case when u >= {edge} then 1 else 0 end" for edge in S.POISSON)
_ALONG = "(({0}x*x + {0}y*y + {0}z*z) / sqrt(x*x + y*y + z*z))"


@query(f"""with {POINTS}, t as (select id, x, y, z, vx, vy, vz, vy ax, vz ay, vx az, 0.5 * vx bx, 0.5 * vy "by", 0.5 * vz bz, 1.0 + id % 3 w from points), e as (select *, unnest(range(1, 61)) draw from t),
 k as (select *, {_TIMES} k from (select *, {random_sql('9', 'draw', 'id')} u from e)),
 g as (select draw, sqrt(sum(k*w*((ax-vx)**2 + (ay-vy)**2 + (az-vz)**2)) / sum(k*w*(vx*vx + vy*vy + vz*vz))) - sqrt(sum(k*w*((bx-vx)**2 + ("by"-vy)**2 + (bz-vz)**2)) / sum(k*w*(vx*vx + vy*vy + vz*vz))) g3,
  sqrt(sum(k*w*({_ALONG.format('a')} - {_ALONG.format('v')})**2) / sum(k*w*{_ALONG.format('v')}**2)) - sqrt(sum(k*w*({_ALONG.format('b').replace('by', '"by"')} - {_ALONG.format('v')})**2) / sum(k*w*{_ALONG.format('v')}**2)) gr from k group by 1)
 select round(avg(g3), 6) delta_3d_mean, round(quantile_cont(g3, 0.025), 6) delta_3d_low, round(quantile_cont(g3, 0.975), 6) delta_3d_high, round(avg(case when g3 < 0 then 1.0 else 0.0 end), 6) share_a_better_3d,
  round(avg(gr), 6) delta_radial_mean, round(quantile_cont(gr, 0.025), 6) delta_radial_low, round(quantile_cont(gr, 0.975), 6) delta_radial_high, round(avg(case when gr < 0 then 1.0 else 0.0 end), 6) share_a_better_radial from g""")
def point_bootstrap(spark, d):
    p = points(spark, d).withColumns({"ax": F.col("vy"), "ay": F.col("vz"), "az": F.col("vx"), **{f"b{a}": 0.5 * F.col(f"v{a}") for a in "xyz"}})
    v = lambda k: [f"{k}x", f"{k}y", f"{k}z"]
    return rounded(S.point_bootstrap(p, "id", v("v"), v("a"), v("b"), ["x", "y", "z"], 1.0 + F.col("id") % 3, 60, 9))


@query("""with c as (select c_custkey id, c_nationkey g from customer where c_custkey % 10 < 4), n as (select g, count(*) n from c group by 1), r as (select c.*, n, row_number() over (partition by c.g order by (id * 1103515245 + 11 * 12345) % 2147483648, id) - 1 k from c join n on c.g = n.g where n >= 3),
 a as (select *, round_even(0.8 * n, 0)::bigint t, round_even(0.2 * n, 0)::bigint v from r)
 select g, id, case when k < t then 'train' when k < t + case when t + v >= n then greatest(1, n - t - 1) else v end then 'validation' else 'test' end split from a""")
def small_group_split(spark, d):
    c = read(spark, d, "customer").where("c_custkey % 10 < 4").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("g"))
    large = c.groupBy("g").count().where("count >= 3").select("g")
    return T.split(c.join(large, "g"), "id", 11, 0.8, 0.2, ["g"]).select("g", "id", "split")


from isofield.plans import evaluation, modes  # noqa: E402, F401  (register more queries over the adapters above)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
