"""Catalog, panel, rule, run-record and page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from labspark.functions import html
from labspark.operators import catalog_ops as ops
from labspark.plans.views import rounded
from labspark.tables import spread_table, table


def _catalog(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("class"), F.col("p_partkey").alias("seq"))


def _resolve(s, d):
    wanted = table(s, d, "part").select(F.split("p_name", " ")[0].alias("text")).distinct().unionByName(table(s, d, "nation").select(F.lower(F.col("n_name")).alias("text")))
    targets = table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("seq"))
    return ops.resolve(targets, wanted.unionByName(table(s, d, "nation").select(F.left("n_name", F.lit(7)).alias("text"))).distinct())


def _packs(s, d):
    o = table(s, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("pack_id"), F.col("o_orderkey").alias("load_seq")).agg(F.max("o_totalprice").alias("title"))


def _presets(s, d):
    panel = table(s, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("target"))
    presets = table(s, d, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("key"))
    return ops.panel_coverage(panel, presets)


def _stack(s, d):
    items = table(s, d, "lineitem").select(F.col("l_suppkey").alias("member"), (F.col("l_partkey") % 50).alias("enzyme"), "l_returnflag", "l_linestatus")
    return ops.interactions(items.filter("l_returnflag = 'R'"), items.filter("l_returnflag = 'A'"))


BANDS = [(g, lo, hi, f"{g} {n}", i) for g in ("AUTOMOBILE", "BUILDING") for i, (lo, hi, n) in enumerate([(-10000.0, 0.0, "poor"), (0.0, 4000.0, "intermediate"), (3000.0, 8000.0, "normal")])]


def _pgx(s, d):
    bands = s.createDataFrame(BANDS, "gene string, low double, high double, note string, seq int")
    return ops.banded_notes(table(s, d, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("gene"), F.col("c_acctbal").alias("activity")), bands, "activity")


QUERIES = {
    "catalog_search": lambda s, d: ops.search(_catalog(s, d), "RED").select("id", "name", "class"),
    "catalog_panel": lambda s, d: ops.search(_catalog(s, d), "econ", limit=None).select("id", "name", "class"),
    "resolve_target": _resolve,
    "pack_overlay": lambda s, d: ops.overlay(_packs(s, d)),
    "pack_dupes": lambda s, d: ops.first_definitions(_packs(s, d), "pack_id", "load_seq")[1],
    "panel_coverage": _presets,
    "panel_summary": lambda s, d: ops.coverage_summary(_presets(s, d), 87),
    "stack_flags": _stack,
    "pgx_notes": _pgx,
    "recent_runs": lambda s, d: ops.recent_runs(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))),
    "verdict_max": lambda s, d: ops.verdict_max(table(s, d, "lineitem"), "l_orderkey", F.col("l_returnflag"), ("N", "A", "R")),
    "html_to_text": lambda s, d: spread_table(s, d, "pages").select("page_id", html.title(F.col("html")).alias("title"), F.md5(F.encode(html.html_to_text(F.col("html")), "utf-8")).alias("digest"), F.size(html.links(F.col("html"))).alias("links")),
    "edge_revenue": lambda s, d: rounded(table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count("*").alias("n")), "revenue", places=2),
}


def _html_sql(x):
    out = f"regexp_replace({x}, '{html.COMMENT}', ' ', 'g')"
    for name in html.BLOCKS:
        out = f"regexp_replace({out}, '{html.block(name)}', ' ', 'g')"
    out = f"regexp_replace({out}, '{html.TAG}', ' ', 'g')"
    for entity, text in html.ENTITIES:
        out = f"replace({out}, '{entity}', '{text.replace(chr(39), chr(39) * 2)}')" if "39" not in entity else f"replace({out}, '&#39;', '''')"
    return f"trim(regexp_replace({out}, '[ \\t\\n\\r]+', ' ', 'g'))"


_PACKS = "packs AS (SELECT o_custkey AS pack_id, o_orderkey AS load_seq, max(o_totalprice) AS title FROM orders GROUP BY 1, 2)"
ORACLES = {
    "catalog_search": "SELECT p_partkey AS id, p_name AS name, p_type AS class FROM part WHERE contains(lower(p_name || ' ' || p_type), 'red') ORDER BY p_partkey LIMIT 25",
    "catalog_panel": "SELECT p_partkey AS id, p_name AS name, p_type AS class FROM part WHERE contains(lower(p_name || ' ' || p_type), 'econ')",
    "resolve_target": """WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS text FROM part UNION SELECT lower(n_name) FROM nation UNION SELECT left(n_name, 7) FROM nation),
h AS (SELECT text, n_nationkey AS id, n_name AS name, lower(text) = lower(n_name) OR lower(text) = CAST(n_nationkey AS VARCHAR) AS exact FROM w JOIN nation ON starts_with(lower(n_name), lower(text)) OR lower(text) = CAST(n_nationkey AS VARCHAR)),
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY exact DESC, id) AS k FROM h)
SELECT w.text, id, name, exact FROM w LEFT JOIN (SELECT * FROM r WHERE k = 1) r USING (text)""",
    "pack_overlay": f"WITH {_PACKS} SELECT pack_id, max(load_seq) AS load_seq, arg_max(title, load_seq) AS title, min(load_seq) AS position FROM packs GROUP BY pack_id",
    "pack_dupes": f"WITH {_PACKS} SELECT pack_id, load_seq, title, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY load_seq) AS nth FROM packs) WHERE nth > 1",
    "panel_coverage": "SELECT n_nationkey AS key, n_name AS target, count(s_suppkey) AS presets, CASE WHEN count(s_suppkey) = 0 THEN 'no preset for this target' END AS reason FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY 1, 2",
    "panel_summary": "SELECT count(DISTINCT s_nationkey) AS screened, 87 - count(DISTINCT s_nationkey) AS unscreened, CAST(87 AS BIGINT) AS panel_size FROM supplier WHERE s_acctbal > 0",
    "stack_flags": """WITH i AS (SELECT DISTINCT l_suppkey AS p, l_partkey % 50 AS e FROM lineitem WHERE l_returnflag = 'R'), v AS (SELECT DISTINCT l_suppkey AS v, l_partkey % 50 AS e FROM lineitem WHERE l_returnflag = 'A')
SELECT p AS perpetrator, v AS victim, count(*) AS enzymes FROM i JOIN v USING (e) WHERE p <> v GROUP BY ALL""",
    "pgx_notes": f"""WITH b(gene, low, high, note, seq) AS (VALUES {', '.join(f"('{g}', {lo}::DOUBLE, {hi}::DOUBLE, '{n}', {i})" for g, lo, hi, n, i in BANDS)})
SELECT c_custkey AS subject, c_mktsegment AS gene, c_acctbal AS activity, arg_min(note, seq) AS note FROM customer LEFT JOIN b ON gene = c_mktsegment AND c_acctbal >= low AND c_acctbal < high GROUP BY ALL""",
    "recent_runs": "SELECT o_orderkey AS id, o_orderstatus AS status, format('run-{:04d}', o_orderkey) AS run FROM orders ORDER BY o_orderkey DESC LIMIT 50",
    "verdict_max": "SELECT l_orderkey, CASE max(CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) WHEN 1 THEN 'N' WHEN 2 THEN 'A' ELSE 'R' END AS verdict FROM lineitem GROUP BY 1",
    "html_to_text": f"SELECT page_id, trim(regexp_extract(html, '(?is:<title[^>]*>(.*?)</title>)', 1)) AS title, md5({_html_sql('html')}) AS digest, CAST(len(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS INTEGER) AS links FROM pages",
    "edge_revenue": "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL",
}
