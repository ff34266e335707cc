"""Enrichment, similarity, structure and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from labspark.operators import enrichment, graph, similarity, structure
from labspark.plans.views import EDGES, GENES, POINTS, gene_sets, points, rounded, trade_edges
from labspark.tables import table


def _fingerprints(s, d):
    """A customer's bits: the part numbers that were ordered, modulo 97."""
    items = table(s, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 97).alias("bit"))
    orders = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("id", "bit").distinct()


def _tanimoto(s, d):
    """The eight customers most like the first customer of each nation."""
    prints = _fingerprints(s, d)
    first = table(s, d, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("id")).select("id")
    return rounded(similarity.tanimoto_top_k(prints.join(first, "id", "left_semi"), prints), "tanimoto", places=9)


def _chain_contacts(s, d):
    found = structure.contacts(points(s, d), 0.1)
    return rounded(found.groupBy("chain_1", "chain_2").agg(F.count("*").alias("contacts"), F.min(F.sqrt("d2")).alias("closest")), "closest")


def _lddt(s, d):
    p = points(s, d)
    model = p.select("atom", "chain", (F.col("x") + F.col("y") * 0.2).alias("x"), "y", (F.col("z") * 1.1).alias("z"))
    return rounded(structure.lddt(p, model, 0.1, (0.005, 0.01, 0.02, 0.04)), "lddt")


def _superpose(s, d):
    p = points(s, d)
    pairs = p.select("chain", "x", "y", "z", (-1.1 * F.col("y")).alias("mx"), (1.1 * F.col("x")).alias("my"), (1.1 * F.col("z") + 5000.0).alias("mz"))
    return rounded(structure.superpose(pairs, "chain"), "rmsd")


def _region_labels(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("label"))


def _component_edges(s, d):
    """Parts and suppliers joined by the line items of the largest quantity and discount: a sparse graph."""
    items = table(s, d, "lineitem").filter("l_quantity = 50 AND l_discount = 0.1")
    return items.select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 100000000).alias("b"))


QUERIES = {
    "enrich_counts": lambda s, d: enrichment.overlaps(*gene_sets(s, d)),
    "enrich_p": lambda s, d: rounded(enrichment.enrich(*gene_sets(s, d)).select("pathway", "overlap", "fold", "p"), "fold", "p"),
    "bh": lambda s, d: rounded(enrichment.enrich(*gene_sets(s, d)).select("pathway", "q"), "q"),
    "tanimoto_topk": _tanimoto,
    "contacts": _chain_contacts,
    "clashes": lambda s, d: structure.clashes(points(s, d), 0.04).groupBy(F.col("chain_1").alias("chain")).agg(F.count("*").alias("clashes")),
    "lddt": _lddt,
    "centroid_moments": lambda s, d: rounded(structure.moments(points(s, d), "chain"), "cx", "cy", "cz", "gyration"),
    "superpose": _superpose,
    "degree": lambda s, d: graph.degree(trade_edges(s, d)),
    "edge_filter": lambda s, d: graph.clean(trade_edges(s, d))[1],
    "components": lambda s, d: graph.components(_component_edges(s, d)),
    "modularity": lambda s, d: rounded(graph.modularity(graph.clean(trade_edges(s, d))[0], _region_labels(s, d)), "q"),
    "betweenness": lambda s, d: rounded(graph.betweenness(trade_edges(s, d).filter("weight % 7 < 2")), "betweenness"),
    "louvain": lambda s, d: graph.louvain(trade_edges(s, d)),
}

_OVER = f"""WITH {GENES}, inside AS (SELECT DISTINCT member FROM query SEMI JOIN background USING (member)),
u AS (SELECT count(*) AS universe, count(i.member) AS drawn FROM background b LEFT JOIN inside i ON b.member = i.member),
o AS (SELECT pathway, count(*) AS size, count(i.member) AS overlap FROM sets s JOIN background b ON s.member = b.member LEFT JOIN inside i ON s.member = i.member GROUP BY pathway HAVING count(*) >= 3 AND count(i.member) > 0),
t AS (SELECT * FROM o, u)"""
_LC = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"
_TAIL = f"""{_OVER}, p AS (SELECT *, least(1.0::DOUBLE, list_sum(list_transform(range(overlap, least(drawn, size) + 1),
  lambda i: exp({_LC.format("size", "i")} + {_LC.format("(universe - size)", "(drawn - i)")} - {_LC.format("universe", "drawn")})))) AS p FROM t)"""
_D2 = "pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)"
ORACLES = {
    "enrich_counts": f"{_OVER} SELECT pathway, size, overlap, drawn, universe FROM t",
    "enrich_p": f"{_TAIL} SELECT pathway, overlap, round(overlap * universe / (drawn * size), 6) AS fold, round(p, 6) AS p FROM p",
    "bh": f"""{_TAIL}, r AS (SELECT pathway, p, count(*) OVER () AS m, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM p)
SELECT pathway, round(least(1.0::DOUBLE, min(p * m / k) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM r""",
    "tanimoto_topk": """WITH fp AS (SELECT DISTINCT o_custkey AS id, l_partkey % 97 AS bit FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT id, count(*) AS n FROM fp GROUP BY id), first AS (SELECT min(c_custkey) AS id FROM customer GROUP BY c_nationkey),
b AS (SELECT q.id AS query_id, f.id AS id, count(*) AS shared FROM fp q JOIN first ON q.id = first.id JOIN fp f ON q.bit = f.bit AND q.id <> f.id GROUP BY ALL),
t AS (SELECT query_id, b.id AS id, CAST(shared AS DOUBLE) / (x.n + y.n - shared) AS tanimoto FROM b JOIN n x ON b.query_id = x.id JOIN n y ON b.id = y.id)
SELECT query_id, id, round(tanimoto, 9) AS tanimoto, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tanimoto DESC, id) AS rank FROM t) WHERE rank <= 8""",
    "contacts": f"WITH {POINTS} SELECT a.chain AS chain_1, b.chain AS chain_2, count(*) AS contacts, round(sqrt(min({_D2})), 6) AS closest FROM points a JOIN points b ON a.chain < b.chain AND {_D2} <= 0.1::DOUBLE * 0.1::DOUBLE GROUP BY ALL",
    "clashes": f"WITH {POINTS} SELECT a.chain AS chain, count(*) AS clashes FROM points a JOIN points b ON a.atom < b.atom AND {_D2} < pow(2 * 0.04::DOUBLE * 0.75::DOUBLE, 2) GROUP BY 1",
    "lddt": f"""WITH {POINTS}, m AS (SELECT atom, x + y * 0.2::DOUBLE AS x, y, z * 1.1::DOUBLE AS z FROM points),
pr AS (SELECT a.atom AS i, b.atom AS j, sqrt({_D2}) AS d FROM points a JOIN points b ON a.atom <> b.atom AND {_D2} <= 0.1::DOUBLE * 0.1::DOUBLE),
c AS (SELECT i, abs(d - sqrt({_D2})) AS e FROM pr JOIN m a ON a.atom = i JOIN m b ON b.atom = j)
SELECT i AS atom, count(*) AS pairs, round(avg(((e < 0.005::DOUBLE)::INT + (e < 0.01::DOUBLE)::INT + (e < 0.02::DOUBLE)::INT + (e < 0.04::DOUBLE)::INT) / 4.0::DOUBLE), 6) AS lddt FROM c GROUP BY 1""",
    "centroid_moments": f"WITH {POINTS} SELECT chain, count(*) AS n, round(avg(x), 6) + 0.0::DOUBLE AS cx, round(avg(y), 6) + 0.0::DOUBLE AS cy, round(avg(z), 6) + 0.0::DOUBLE AS cz, round(sqrt(avg(x * x + y * y + z * z) - avg(x) * avg(x) - avg(y) * avg(y) - avg(z) * avg(z)), 6) AS gyration FROM points GROUP BY chain",
    "superpose": f"WITH {POINTS} SELECT chain, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(0.1::DOUBLE * sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) END AS rmsd FROM points GROUP BY chain",
    "degree": f"WITH {EDGES}, e AS (SELECT source AS node, weight FROM edges UNION ALL SELECT target, weight FROM edges) SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM e GROUP BY node",
    "edge_filter": f"WITH {EDGES} SELECT source, target, weight, 'self-loop' AS reason FROM edges WHERE source = target",
    "components": """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 100000000 AS b FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1::DOUBLE),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, component) AS (SELECT a, a FROM g UNION SELECT g.b, r.component FROM r JOIN g ON r.node = g.a AND r.component < g.b)
SELECT node, min(component) AS component FROM r GROUP BY node""",
    "modularity": f"""WITH {EDGES}, k AS (SELECT * FROM edges WHERE source <> target), t AS (SELECT CAST(sum(weight) AS DOUBLE) AS m FROM k),
i AS (SELECT a.n_regionkey AS label, sum(weight) AS w FROM k JOIN nation a ON source = a.n_nationkey JOIN nation b ON target = b.n_nationkey WHERE a.n_regionkey = b.n_regionkey GROUP BY 1),
s AS (SELECT n_regionkey AS label, sum(weight) AS s FROM (SELECT source AS node, weight FROM k UNION ALL SELECT target, weight FROM k) JOIN nation ON node = n_nationkey GROUP BY 1)
SELECT round(sum(coalesce(w, 0) / m - pow(s / (2 * m), 2)), 6) + 0.0::DOUBLE AS q FROM s LEFT JOIN i USING (label), t""",
}
