"""Queries of distributions and nested columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.columns import small_side
from tidemark.functions import distributions as ds, nested as ne
from tidemark.operators.aggregate import class_distribution
from workloads.fixtures import table
from workloads.registry import flat, query

_MIX = """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
k AS (SELECT event_type, count(*) / (SELECT count(*) FROM events) AS p FROM events GROUP BY 1),
u AS (SELECT user_id, sum(n) AS total FROM c GROUP BY 1),
mix AS (SELECT u.user_id, k.event_type, coalesce(n, 0) / total AS a, p FROM u CROSS JOIN k LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = k.event_type)"""


def type_mix(spark, sf):
    """Per user: share of each event type next to its overall share."""
    e = table(spark, sf, "events")
    whole = class_distribution(e, [], "event_type", e.select("event_type")).withColumnRenamed("prob", "p")
    mine = class_distribution(e, ["user_id"], "event_type", e.select("event_type")).withColumnRenamed("prob", "a")
    return mine.join(small_side(whole), "event_type")


@query("l1_kl_divergence", _MIX + " SELECT user_id, round(sum(CASE WHEN a > 0 THEN a * ln(a / p) / ln(2) ELSE 0 END), 6) AS kl FROM mix GROUP BY 1")
def l1(spark, sf):
    return flat(ds.kl_divergence(type_mix(spark, sf), ["user_id"], "a", "p"))


@query("l2_js_divergence", _MIX + """
, m AS (SELECT *, (a + p) / 2 AS m FROM mix)
SELECT user_id, round(sum(CASE WHEN a > 0 THEN a * ln(a / m) ELSE 0 END + p * ln(p / m)) / 2 / ln(2), 6) AS jsd FROM m GROUP BY 1""")
def l2(spark, sf):
    return flat(ds.js_divergence(type_mix(spark, sf), ["user_id"], "a", "p"))


@query("l3_js_divergence_rows", _MIX + """
, m AS (SELECT *, (a + p) / 2 AS m FROM (SELECT user_id, a, CASE event_type WHEN 'view' THEN 0.5 WHEN 'click' THEN 0.25 WHEN 'purchase' THEN 0.25 ELSE 0 END AS p
        FROM mix WHERE event_type IN ('view', 'click', 'purchase', 'error')))
SELECT user_id, round(sum(CASE WHEN a > 0 THEN a * ln(a / m) ELSE 0 END + CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END) / 2 / ln(2), 6) AS jsd FROM m GROUP BY 1""")
def l3(spark, sf):
    d = type_mix(spark, sf).filter("a > 0").groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", "a"))).alias("actual_dist"))
    d = d.withColumns({"view": F.lit(0.5), "click": F.lit(0.25), "purchase": F.lit(0.25), "error": F.lit(None).cast("double")})
    return flat(ds.js_divergence_rows(d, "actual_dist", ["view", "click", "purchase", "error"]).select("user_id", "jsd"))


_MOMENTS = """
WITH c AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2),
m AS (SELECT user_id, avg(n) AS mean, stddev_samp(n) AS std FROM c GROUP BY 1),
nb AS (SELECT *, CASE WHEN std * std > mean THEN mean / (std * std) END AS p, CASE WHEN std * std > mean THEN mean * mean / (std * std - mean) END AS k FROM m)"""


def moments(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return ds.count_moments(c, ["user_id"], "n")


@query("l4_nb_params", _MOMENTS + " SELECT user_id, round(p, 6) AS nb_p, CAST(CASE WHEN k IS NULL THEN 0 ELSE 1 END AS BIGINT) AS known FROM nb")
def l4(spark, sf):
    d = ds.nb_params(moments(spark, sf), var="var")
    return flat(d.select("user_id", "nb_p", F.col("nb_n").isNotNull().alias("known")))


_SUPPORT = ", s AS (SELECT *, unnest(generate_series(CAST(greatest(floor(mean - 3 * std), 0) AS BIGINT), CAST(greatest(ceil(mean + 3 * std), 0) AS BIGINT))) AS support FROM nb"


@query("l5_nb_probabilities", _MOMENTS + _SUPPORT + """ WHERE p IS NOT NULL),
q AS (SELECT *, exp(lgamma(k + support) - lgamma(support + 1) - lgamma(k) + k * ln(p) + support * ln(1 - p)) AS pmf FROM s)
SELECT user_id, support, round(pmf / sum(pmf) OVER (PARTITION BY user_id), 5) AS prob FROM q""")
def l5(spark, sf):
    return flat(ds.nb_probabilities(moments(spark, sf), ["user_id"], 3, var="var"), 5)


@query("l6_norm_probabilities", _MOMENTS + _SUPPORT + """ WHERE std > 0),
q AS (SELECT *, exp(-0.5 * pow((support - mean) / std, 2)) AS pdf FROM s)
SELECT user_id, support, round(pdf / sum(pdf) OVER (PARTITION BY user_id), 6) AS prob FROM q""")
def l6(spark, sf):
    return flat(ds.norm_probabilities(moments(spark, sf), ["user_id"], 3))

# --- nested columns


def nested(spark, sf):
    """Per customer segment: map of region -> map of nation -> order count."""
    d = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    d = d.groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    d = d.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    inner = d.groupBy("c_mktsegment", "r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n"))).alias("m"))
    return inner.groupBy("c_mktsegment").agg(F.map_from_entries(F.collect_list(F.struct("r_name", "m"))).alias("tree"))


_TREE = """
WITH t AS (SELECT c_mktsegment, r_name AS region, n_name AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
           JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)"""


@query("m1_flatten_map", _TREE + ' SELECT c_mktsegment, region, nation, n AS "values" FROM t')
def m1(spark, sf):
    return flat(ne.flatten_map(nested(spark, sf), "tree", ["region", "nation"]))


@query("m2_deep_sum", _TREE + """
SELECT c_mktsegment, CAST(sum(n) AS DOUBLE) AS total, CAST(coalesce(sum(CASE WHEN region <> 'ASIA' AND nation <> 'NATION_3' THEN n END), 0) AS DOUBLE) AS some FROM t GROUP BY 1""")
def m2(spark, sf):
    d = ne.deep_sum(nested(spark, sf), "tree", "total")
    return flat(ne.deep_sum(d, "tree", "some", ["ASIA", "NATION_3"]).select("c_mktsegment", "total", "some"))


@query("m2_deep_sum_arrays", "SELECT vec_id, round(list_sum([x::DOUBLE for x in embedding]), 4) AS total FROM embeddings")
def m2a(spark, sf):
    return flat(ne.deep_sum(table(spark, sf, "embeddings"), "embedding", "total").select("vec_id", "total"), 4)


@query("m3_deep_sum_count", """
SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS DOUBLE) AS x_sum, count(*) AS x_count FROM events GROUP BY 1""")
def m3(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.from_json("props", "k long, skipped long"))
    # Every event on its own, then summed: the nested part stays small.
    d = ne.deep_sum_count(e, "p", "x", ["skipped"])
    return flat(d.groupBy("user_id").agg(F.sum("x_sum").alias("x_sum"), F.sum("x_count").alias("x_count")))


@query("m4_numeric_leaves", _TREE + " SELECT c_mktsegment, 'tree.' || region || '.' || nation AS path, CAST(n AS DOUBLE) AS value FROM t WHERE region <> 'ASIA'")
def m4(spark, sf):
    return flat(ne.numeric_leaves(nested(spark, sf), "tree", ["c_mktsegment"], ["ASIA"]))


@query("m5_flatten_lists", """
SELECT vec_id, i, round(embedding[i + 1]::DOUBLE, 5) AS v FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)""")
def m5(spark, sf):
    d = table(spark, sf, "embeddings")
    # Each vector as a list of lists of lists, in uneven pieces.
    cut = lambda a, b: F.slice("embedding", a, b)
    rest = F.expr("slice(embedding, 21, size(embedding) - 20)")
    d = d.withColumn("lists", F.array(F.array(cut(1, 3), cut(4, 7)), F.array(cut(11, 10)), F.array(rest)))
    return flat(ne.flatten_lists(d, "lists").select("vec_id", F.posexplode("lists").alias("i", "v")), 5)
