"""Queries of eigenvectors, their continuation, extension and comparison, over the adapters of the registry."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isofield.operators import graph as G
from isofield.operators import spectral as E
from isofield.plans.registry import EDGES, edges8, points, query, read, rounded, weights8
from isofield.sources.blocks import BlockStore
from isofield.sources.shared import cut, fresh

TRADE = """flow as (select c_nationkey a, s_nationkey b, count(*)::double n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by all),
 both_ways as (select i, j, sum(n) n from (select a i, b j, n from flow union all select b, a, n from flow) group by all), total as (select i, sum(n) d from both_ways group by 1),
 s as (select b.i, b.j, n / sqrt(x.d * y.d) s from both_ways b join total x on b.i = x.i join total y on b.j = y.i)"""


def trade(spark, d) -> DataFrame:
    """Line items between the nations of customers and suppliers, both ways, over the roots of the nations' totals."""
    li, o, c, s = (read(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    flow = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")) \
        .groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    both = cut(flow.unionByName(flow.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")).groupBy("src", "dst").agg(F.sum("n").alias("n")))
    total = both.groupBy("src").agg(F.sum("n").alias("d"))
    return both.join(total, "src").join(total.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst").select("src", "dst", (F.col("n") / F.sqrt(F.col("d") * F.col("e"))).alias("s"))


@query(f"with {TRADE} select i node, 1.0::double complete, round(sum(case when i = j then s else 0 end), 8) diagonal, round(sum(s * s), 8) square from s group by 1")
def operator_modes(spark, d):
    """All modes of an operator, 9 and then the rest in locked blocks of 9, put together again: sums of v^2, value v^2 and value^2 v^2."""
    edges = cut(trade(spark, d))
    nodes = edges.select(F.col("src").alias("id")).distinct()
    store = BlockStore(spark, fresh(spark), {"table": "trade"})
    E.continued(edges, nodes, 9, store, 9)
    modes = E.continued(edges, nodes, 10 ** 6, store, 9)
    values = F.array(*[F.lit(float(v)) for v in modes.values])
    t = modes.table().select("id", "value", F.get(values, F.col("mode")).alias("lambda"))
    v2 = F.col("value") ** 2
    return rounded(t.groupBy(F.col("id").alias("node")).agg(F.sum(v2).alias("complete"), F.sum(v2 * F.col("lambda")).alias("diagonal"), F.sum(v2 * F.col("lambda") ** 2).alias("square")), 8)


@query(f"""with {EDGES}, q as (select src id, sum(w) q from weights group by 1), k as (select src, dst, w / (a.q * b.q) w from weights join q a on src = a.id join q b on dst = b.id),
 d as (select src id, sum(w) d from k group by 1), f as (select count(*) n from d) select id, round(d / (select sum(d) from d), 6) square, (select 2 from f) as modes, 0.0::double residual, 1.0::double largest from d""")
def leading_modes(spark, d):
    """Two modes of the points' operator: the square of the first is the stationary measure, its value is 1, residual norms are nil."""
    mass = points(spark, d).select("id", F.lit(1.0).alias("w"))
    edges, _ = G.alpha_operator(weights8(spark, d)[2], mass, 1.0)
    modes = E.continued(cut(edges), mass.select("id"), 2, BlockStore(spark, fresh(spark), {"table": "points"}), 2, 30, tolerance=1e-7)
    first = modes.table().where("mode = 0").select("id", (F.col("value") ** 2).alias("square"))
    return rounded(first.select("id", F.round("square", 6).alias("square"), F.lit(len(modes.values)).alias("modes"), F.lit(round(float(modes.residuals.max()), 5)).alias("residual"),
                                F.lit(round(float(modes.values[0]), 8)).alias("largest")), 8)


@query(f"""with {EDGES}, m as (select id, (1 + id % 3)::double w from points), q as (select src id, sum(k.w * m.w) q from weights k join m on dst = m.id group by 1),
 near as (select * from edges where src % 5 = 0 and rank <= 6), nrho as (select src, dist rho from near where rank = 4),
 k as (select n.src, n.dst, exp(-(n.dist*n.dist)/(a.rho*b.rho)) k, m.w, q.q from near n join nrho a on n.src = a.src join rho b on n.dst = b.src join m on n.dst = m.id join q on n.dst = q.id),
 o as (select *, sum(k * w) over (partition by src) own from k), r as (select *, k / sqrt(own * q) * w row from o), p as (select *, row / sum(row) over (partition by src) p, sum(row) over (partition by src) total from r)
 select src, round(any_value(own), 6) q, round(any_value(total), 6) total, round(sum(p), 6) e0, round(sum(p * x) / 0.5, 6) e1, round(sum(p * y) / -0.25, 6) e2, null::double e3 from p join points on dst = id group by src""")
def extended_modes(spark, d):
    """Functions of the points carried to every fifth point by its own neighbours, as modes of values 1, 0.5, -0.25 and one too small."""
    p = points(spark, d)
    e, rho, w = weights8(spark, d)
    mass = p.select("id", (1 + F.col("id") % 3).cast("double").alias("w"))
    nodes = mass.join(G.apply(w, mass.withColumnRenamed("w", "v"), "w", "q").withColumnRenamed("src", "id"), "id")
    near = e.where("src % 5 = 0 and rank <= 6")
    t = cut(G.query_transition(near, G.bandwidth(near, 4), rho, nodes, 0.5))
    modes = p.select("id", F.lit(0).alias("block"), F.array(F.lit(1.0), "x").alias("v")).unionByName(p.select("id", F.lit(1).alias("block"), F.array("y", "z").alias("v")))
    out = G.extend_modes(t, modes, {0: [1.0, 0.5], 1: [-0.25, 1e-11]})
    at = lambda b, k: F.max(F.when(F.col("block") == b, F.get("v", F.lit(k))))
    wide = out.groupBy("src").agg(at(0, 0).alias("e0"), at(0, 1).alias("e1"), at(1, 0).alias("e2"), at(1, 1).alias("e3"))
    return rounded(t.groupBy("src").agg(F.max("q").alias("q"), F.max("total").alias("total")).join(wide, "src"))


_ANGLE = 0.6
_COSINES = ", ".join(f"sqrt(2.0 / n) * cos(pi() * {k} * (r + 0.5) / n) m{k}" for k in range(1, 6))


@query(f"""with o as (select vec_id id, embedding[1]::double x, row_number() over (order by vec_id) - 1 r, count(*) over () n from embeddings),
 old as (select *, {_COSINES} from o),
 b as (select *, -m1 + 0.01 * x * m1 n1, {math.cos(_ANGLE)} * m2 + {math.sin(_ANGLE)} * m3 n2, {math.sin(_ANGLE)} * m2 - {math.cos(_ANGLE)} * m3 + 0.02 * x * m2 n3, m4 n4, -m5 n5 from old),
 c as (select sum(m2*n2) a, sum(m2*n3) b, sum(m3*n2) c, sum(m3*n3) d, sum(m1*n1) s1, sum(m4*n4) s4, sum(m5*n5) s5 from b),
 f as (select *, sqrt((a-d)*(a-d) + (b+c)*(b+c)) h from c),
 g as (select max(abs(sign(s1)*n1 - m1)) d1, max(greatest(abs(((a-d)*n2 + (b+c)*n3)/h - m2), abs(((b+c)*n2 - (a-d)*n3)/h - m3))) d2, max(abs(sign(s4)*n4 - m4)) d4, max(abs(sign(s5)*n5 - m5)) d5 from b, f)
 select 0 as "first", 0 as "last", round(abs(s1), 6) least_cosine, round(d1, 6) largest_deviation, '-1' signs from f, g
 union all select 1, 2, round(abs(h - sqrt((a+d)*(a+d) + (b-c)*(b-c))) / 2, 6), round(d2, 6), sign(a)::int || ',' || sign(d)::int from f, g
 union all select 3, 3, round(abs(s4), 6), round(d4, 6), '1' from f, g union all select 4, 4, round(abs(s5), 6), round(d5, 6), '-1' from f, g""")
def matched_modes(spark, d):
    """Cosines over the vectors' order, negated, mixed within a pair of equal values and perturbed, brought back."""
    from isofield.operators import relational as R

    o = R.ranked_within(read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.lit(0).alias("g")), ["g"], ["id"], "r", "n")
    m = [F.sqrt(2.0 / F.col("n")) * F.cos(F.lit(math.pi * k) * (F.col("r") + 0.5) / F.col("n")) for k in range(1, 6)]
    x, a, b = F.col("x"), math.cos(_ANGLE), math.sin(_ANGLE)
    old = cut(o.select("id", F.array(*m).alias("v")))
    new = cut(o.select("id", F.array(-m[0] + 0.01 * x * m[0], a * m[1] + b * m[2], b * m[1] - a * m[2] + 0.02 * x * m[1], m[3], -m[4]).alias("v")))
    _, groups = E.matched(new, old, old.select("id", F.lit(1.0).alias("w")), np.array([0.9, 0.8, 0.8, 0.7, 0.6]))
    rows = [(g["first"], g["last"], g["least_cosine"], g["largest_deviation"], ",".join(map(str, g["signs"]))) for g in groups]
    return rounded(spark.createDataFrame(rows, "first int, last int, least_cosine double, largest_deviation double, signs string"))
