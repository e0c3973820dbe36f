"""Feature vectors: pooling, centres, contrastive scores, F scores. Stand-in: embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.numeric import tidy
from pulsegrid.operators import quality as Q
from pulsegrid.queries import query
from pulsegrid.queries.fragments import VEC_SQL, vectors

_CENTRES = f"{VEC_SQL}, c AS (SELECT label, idx, avg(x) AS m FROM v GROUP BY ALL)"


@query("A10", sql=f"WITH {_CENTRES} SELECT label, idx::integer AS idx, round(m, 6) + 0.0 AS value FROM c")
def class_centroids(spark, d):
    c = Q.mean_pool(vectors(spark, d), ["label"], "x")
    return c.select("label", F.posexplode_outer("centre").alias("idx", "value")).withColumn(
        "value", tidy(F.col("value")))


@query("J9", sql=f"""WITH {_CENTRES}
    SELECT vec_id, round(sum((x - m) ** 2), 6) + 0.0 AS centre_distance
    FROM v JOIN c USING (label, idx) GROUP BY vec_id""")
def centre_distances(spark, d):
    return Q.centre_distance(vectors(spark, d), "x").select(
        "vec_id", tidy(F.col("centre_distance")).alias("centre_distance"))


_CONTRAST = f"""{VEC_SQL},
    b AS (SELECT vec_id, label, (row_number() OVER (ORDER BY md5('0:batch:' || vec_id), vec_id) - 1) // 32 AS batch
          FROM embeddings),
    nrm AS (SELECT vec_id, idx, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12) AS x FROM v),
    sim AS (SELECT p.batch, p.vec_id, q.vec_id AS other, any_value(p.label) = any_value(q.label) AS same, sum(a.x * z.x) / 0.7 AS s
        FROM b p JOIN b q USING (batch) JOIN nrm a ON a.vec_id = p.vec_id JOIN nrm z ON z.vec_id = q.vec_id AND z.idx = a.idx
        GROUP BY p.batch, p.vec_id, q.vec_id),
    top AS (SELECT *, s - max(s) OVER (PARTITION BY vec_id) AS t FROM sim),
    lp AS (SELECT *, t - ln(sum(CASE WHEN vec_id <> other THEN exp(t) ELSE 0 END) OVER (PARTITION BY vec_id) + 1e-8) AS l FROM top),
    con AS (SELECT batch, vec_id, count(*) FILTER (same AND vec_id <> other) AS partners,
        avg(l) FILTER (same AND vec_id <> other) AS m FROM lp GROUP BY ALL)"""


@query("J8", sql=f"WITH {_CONTRAST} SELECT batch, vec_id, partners, round(m, 6) + 0.0 AS mean_log_prob FROM con")
def contrastive_scores(spark, d):
    batched = Q.batches(vectors(spark, d), "vec_id", 32)
    return Q.contrastive(batched, "vec_id", "x").withColumn("mean_log_prob", tidy(F.col("mean_log_prob")))


_OBJ = _CONTRAST.replace("any_value(p.label) = any_value(q.label)",
                         "(any_value(p.label) % 2) = (any_value(q.label) % 2)")


@query("M9", sql=f"""WITH {_OBJ},
    c AS (SELECT label % 2 AS y, idx, avg(x) AS m FROM v GROUP BY ALL),
    dist AS (SELECT vec_id, sum((x - m) ** 2) AS dd FROM v JOIN c ON y = label % 2 AND c.idx = v.idx GROUP BY vec_id),
    ce AS (SELECT vec_id, ln(exp(embedding[1]::double) + exp(embedding[2]::double))
             - embedding[1 + label % 2]::double AS ce FROM embeddings),
    parts AS (SELECT b.batch, avg(ce) AS ce, avg(dd) AS dd FROM b JOIN dist USING (vec_id) JOIN ce USING (vec_id) GROUP BY ALL),
    cb AS (SELECT batch, coalesce(-avg(m), 0) AS con FROM con GROUP BY batch)
    SELECT batch, round(con, 6) + 0.0 AS contrastive, round(ce, 6) + 0.0 AS classification,
        round(dd, 6) + 0.0 AS centre, round(0.2::double * con + 0.5::double * ce + 0.01::double * dd, 6) + 0.0 AS total
    FROM parts JOIN cb USING (batch)""")
def batch_objectives(spark, d):
    rows = vectors(spark, d).select("vec_id", (F.col("label") % 2).alias("label"), "x", F.slice("x", 1, 2).alias("z"))
    out = Q.objective(Q.batches(rows, "vec_id", 32), "vec_id", "x", "z")
    return out.select("batch", *[tidy(F.col(c)).alias(c) for c in
                                 ("contrastive", "classification", "centre", "total")])


@query("K3", sql=f"""WITH {VEC_SQL},
    g AS (SELECT idx, label, count(*) AS n, avg(x) AS m, sum(x) AS s FROM v GROUP BY ALL),
    w AS (SELECT idx, sum((x - m) ** 2) AS ssw, count(*) AS n FROM v JOIN g USING (idx, label) GROUP BY idx),
    t AS (SELECT idx, avg(x) AS m FROM v GROUP BY idx),
    bb AS (SELECT idx, sum(g.n * (g.m - t.m) ** 2) AS ssb, count(*) AS k FROM g JOIN t USING (idx) GROUP BY idx)
    SELECT idx::integer AS feature, round((ssb / (k - 1)) / (ssw / (n - k)), 6) + 0.0 AS f
    FROM bb JOIN w USING (idx) ORDER BY f DESC, feature LIMIT 20""")
def best_features(spark, d):
    return Q.best_features(vectors(spark, d), "x", 20).withColumn("f", tidy(F.col("f")))
