"""Term graph, leak-safe features, clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import ontology as T
from .tables import rounded, table


def term_edges(spark, sf):
    """A term graph with several parents per term: customers below customers
    with smaller numbers, below nations, below regions."""
    customers = table(spark, sf, "customer")
    nations = table(spark, sf, "nation")
    up = customers.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("c"), F.col("c_custkey")).alias("child"),
        F.array(
            F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 2)),
            F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 3)),
            F.concat(F.lit("n"), F.col("c_nationkey")),
        ).alias("parents"),
    ).select("child", F.explode("parents").alias("parent"))
    top = nations.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"))
    return up.unionByName(top).where("child <> parent").distinct()


EDGES = """
edges AS (
  SELECT 'c' || c_custkey AS child, 'c' || (c_custkey // 2) AS parent FROM customer WHERE c_custkey > 0
  UNION SELECT 'c' || c_custkey, 'c' || (c_custkey // 3) FROM customer WHERE c_custkey > 0
  UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
),
up(term, relative) AS (
  SELECT child, parent FROM edges
  UNION
  SELECT term, parent FROM up JOIN edges ON up.relative = edges.child
),
related AS (
  SELECT term, relative, 'ancestor' AS side FROM up UNION ALL SELECT relative, term, 'descendant' FROM up
)"""


def term_matrix(spark, sf):
    """``(key, feature, value)``: orders carry the terms of their customer and
    its number, and a feature outside the ontology."""
    orders = table(spark, sf, "orders")
    names = F.array(
        F.concat(F.lit("go_c"), F.col("o_custkey")),
        F.concat(F.lit("go_c"), F.floor(F.col("o_custkey") / 2)),
        F.concat(F.lit("pfa_"), F.col("o_orderpriority")),
    )
    cells = orders.select(F.col("o_orderkey").alias("key"), F.explode(F.array_distinct(names)).alias("feature"))
    return cells.withColumn("value", F.lit(1.0))


MATRIX = """
cells AS (
  SELECT o_orderkey AS key, 'go_c' || o_custkey AS feature FROM orders
  UNION SELECT o_orderkey, 'go_c' || (o_custkey // 2) FROM orders
  UNION SELECT o_orderkey, 'pfa_' || o_orderpriority FROM orders
)"""

# The target of the single-target query.
TARGET = "go_c5"


def _targets(spark, sf):
    return term_matrix(spark, sf).select(F.col("feature").alias("target")).distinct()


def _kept(spark, sf):
    targets = _targets(spark, sf)
    return T.kept_features(term_matrix(spark, sf), T.exclusions(targets, term_edges(spark, sf)), targets)


def _leak_safe(spark, sf):
    excluded = T.exclusions(spark.createDataFrame([(TARGET,)], "target STRING"), term_edges(spark, sf), include_self=True)
    return T.leak_safe(term_matrix(spark, sf), excluded, TARGET)


def item_edges(spark, sf):
    """Weighted directed network of suppliers."""
    n = table(spark, sf, "supplier").count()
    items = table(spark, sf, "lineitem")
    return items.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % n).alias("dst")).agg(F.sum("l_quantity").alias("w"))


def order_edges(spark, sf):
    """Orders linked to their customer, customers to their block of ten."""
    orders = table(spark, sf, "orders")
    block = F.concat(F.lit("b"), F.floor(F.col("o_custkey") / 10))
    customer = F.concat(F.lit("c"), F.col("o_custkey"))
    first = orders.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("src"), customer.alias("dst"), F.lit(1.0).alias("w"))
    return first.unionByName(orders.select(customer.alias("src"), block.alias("dst"), F.lit(0.5).alias("w")).distinct())


COMPONENTS_SQL = """WITH RECURSIVE
half AS (SELECT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders
         UNION SELECT 'c' || o_custkey, 'b' || (o_custkey // 10) FROM orders),
links AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
reach(node, seen) AS (SELECT a, a FROM links UNION SELECT reach.node, b FROM reach JOIN links ON reach.seen = links.a)
SELECT node, min(seen) AS component FROM reach GROUP BY node"""


def _cluster_sizes(spark, sf):
    clusters = G.mcl(order_edges(spark, sf), inflation=2.0)
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_nodes"))


def _flow(spark, sf):
    """The flow matrix after two rounds of Markov clustering."""
    cells = G.flow_round(G.flow_round(G.flow_matrix(order_edges(spark, sf))))
    return rounded(cells.select("i", "j", "p"), "p")


def _flow_round_sql(n: int) -> str:
    """CTEs from the matrix ``m{n - 1}`` to ``m{n}``."""
    return f"""s{n} AS (SELECT a.i, b.j, pow(sum(a.p * b.p), 2) AS p FROM m{n - 1} a JOIN m{n - 1} b ON a.j = b.i GROUP BY 1, 2),
t{n} AS (SELECT i, j, p / sum(p) OVER (PARTITION BY j) AS p FROM s{n}),
u{n} AS (SELECT * FROM t{n} QUALIFY p >= 1e-5 OR p >= max(p) OVER (PARTITION BY j) * (1 - 1e-9)),
m{n} AS (SELECT i, j, p / sum(p) OVER (PARTITION BY j) AS p FROM u{n})"""


FLOW_SQL = f"""WITH e AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 1.0::DOUBLE AS w FROM orders
  UNION ALL SELECT DISTINCT 'c' || o_custkey, 'b' || (o_custkey // 10), 0.5::DOUBLE FROM orders),
w AS (SELECT i, j, max(w) AS p FROM (SELECT src AS i, dst AS j, w FROM e UNION ALL SELECT dst, src, w FROM e) WHERE i <> j GROUP BY 1, 2),
l AS (SELECT * FROM w UNION ALL SELECT j, j, max(p) FROM w GROUP BY j),
m0 AS (SELECT i, j, p / sum(p) OVER (PARTITION BY j) AS p FROM l),
{_flow_round_sql(1)}, {_flow_round_sql(2)}
SELECT i, j, round(p, 6) AS p FROM m2"""


QUERIES = {
    "ontology_closure": (
        lambda spark, sf: T.closure(term_edges(spark, sf)),
        f"WITH RECURSIVE {EDGES} SELECT term, relative, side FROM related",
    ),
    "ontology_exclusions": (
        lambda spark, sf: T.exclusions(_targets(spark, sf), term_edges(spark, sf), include_self=True),
        f"""WITH RECURSIVE {EDGES}, {MATRIX}
        SELECT DISTINCT 'go_' || term AS target, 'go_' || relative AS feature FROM related
        WHERE 'go_' || term IN (SELECT feature FROM cells)
        UNION SELECT feature, feature FROM cells""",
    ),
    "mate_exclusions": (
        lambda spark, sf: T.mate_exclusions(
            table(spark, sf, "lineitem").select(
                F.concat_ws("_", F.lit("dge"), "l_partkey", F.when(F.col("l_returnflag") == "A", "up").otherwise("down")).alias("target")
            )
        ),
        """SELECT DISTINCT 'dge_' || l_partkey || CASE WHEN l_returnflag = 'A' THEN '_up' ELSE '_down' END AS target,
        'dge_' || l_partkey || CASE WHEN l_returnflag = 'A' THEN '_down' ELSE '_up' END AS feature FROM lineitem""",
    ),
    "leak_safe_features": (
        _leak_safe,
        f"""WITH RECURSIVE {EDGES}, {MATRIX}
        SELECT key, feature, CAST(1 AS DOUBLE) AS value FROM cells
        WHERE feature <> '{TARGET}' AND feature NOT IN (SELECT 'go_' || relative FROM related WHERE 'go_' || term = '{TARGET}')""",
    ),
    "kept_features_per_target": (
        _kept,
        f"""WITH RECURSIVE {EDGES}, {MATRIX}, names AS (SELECT DISTINCT feature FROM cells),
        gone AS (SELECT DISTINCT 'go_' || term AS target, 'go_' || relative AS feature FROM related)
        SELECT n.feature AS target, count(g.feature) AS n_removed, (SELECT count(*) FROM names) - count(g.feature) AS n_kept
        FROM names n LEFT JOIN (SELECT * FROM gone WHERE feature IN (SELECT feature FROM names)) g ON g.target = n.feature
        GROUP BY n.feature""",
    ),
    "asymmetric_edges": (
        lambda spark, sf: G.asymmetric_edges(item_edges(spark, sf)),
        """WITH e AS (SELECT l_suppkey AS src, l_partkey % (SELECT count(*) FROM supplier) AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2)
        SELECT a.src, a.dst, a.w FROM e a LEFT JOIN e b ON a.src = b.dst AND a.dst = b.src AND a.w = b.w
        WHERE b.src IS NULL AND a.src <> a.dst""",
    ),
    "connected_components": (lambda spark, sf: G.components(order_edges(spark, sf)), COMPONENTS_SQL),
    "markov_clusters": (_cluster_sizes, None),
    "markov_flow": (_flow, FLOW_SQL),
}
