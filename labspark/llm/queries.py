"""The registered queries of the ten operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.llm import op1_chat, op10_licenses, op2_mixing, op3_packing, op4_topk, op5_lines, op6_jaccard, op7_decontaminate, op8_quality, op9_token_counts
from labspark.tables import spread_table, table

Query = Callable[[SparkSession, str], DataFrame]

TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5"""


_CONTROLS = r"regexp_extract_all({0}, '<\\*/?s>|\[\\*/?INST\]')"
CHAT_SQL = f"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
k AS (SELECT *, length(role) + len({_CONTROLS.format("role")}) + length(text) + len({_CONTROLS.format("text")}) + 17 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM k GROUP BY conv_id"""

LINES_SQL = r"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
keyed AS (SELECT *, row_number() OVER () AS doc FROM docs),
raw AS (SELECT doc, i AS pos, string_split(text, chr(10))[i] AS line FROM keyed, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
masked AS (SELECT doc, pos, line, regexp_replace(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM raw),
parsed AS (SELECT *, len(string_split(m, ' ')) AS n, array_to_string(string_split(m, ' ')[1:3], ' ') AS head FROM masked WHERE m <> ''),
counted AS (SELECT * FROM parsed WHERE n >= 3),
once AS (SELECT n, head, m, count(DISTINCT doc) AS docs FROM counted GROUP BY ALL),
crowded AS (SELECT *, count(*) OVER (PARTITION BY n, head) AS lines FROM once),
tokens AS (SELECT n, head, m, docs, i AS place, string_split(m, ' ')[i] AS token FROM crowded, unnest(range(1, n + 1)) AS u(i) WHERE lines > 1),
support AS (SELECT *, token <> '<*>' AND sum(docs) OVER (PARTITION BY n, head, place, token) >= 2 AS fixed FROM tokens),
shapes AS (SELECT m, string_agg(CASE WHEN fixed THEN 'c' || token ELSE '*' END, ' ' ORDER BY place) AS shape, count(*) FILTER (fixed) AS n_fixed FROM support GROUP BY m),
known AS (SELECT c.doc, c.pos, c.m, c.n, coalesce('s' || s.shape, 'l' || c.m) AS shape, c.head FROM counted c LEFT JOIN shapes s ON c.m = s.m WHERE s.m IS NULL OR s.n_fixed >= 0.5::DOUBLE * c.n),
recurring AS (SELECT n, head, shape FROM known GROUP BY ALL HAVING count(DISTINCT doc) >= CASE WHEN n >= 10 THEN 2 ELSE 10 END),
dropped AS (SELECT DISTINCT k.m FROM known k JOIN recurring r ON k.n = r.n AND k.head = r.head AND k.shape = r.shape),
lost AS (SELECT c.doc, c.pos FROM counted c JOIN dropped d ON c.m = d.m),
kept AS (SELECT r.doc, count(l.pos) AS n_dropped, coalesce(string_agg(r.line, chr(10) ORDER BY r.pos) FILTER (l.pos IS NULL), '') AS text FROM raw r LEFT JOIN lost l ON r.doc = l.doc AND r.pos = l.pos GROUP BY r.doc)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS INTEGER) AS n_lines, CAST(coalesce(n_dropped, 0) AS INTEGER) AS n_dropped,
  CASE WHEN d.text IS NULL THEN NULL WHEN n_dropped = 0 THEN d.text ELSE kept.text END AS text
FROM documents d LEFT JOIN keyed k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.text = k.text LEFT JOIN kept ON k.doc = kept.doc"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (na + nb - shared)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, component) AS (SELECT doc_id, doc_id FROM documents UNION SELECT g.b, r.component FROM r JOIN g ON r.doc_id = g.a AND r.component < g.b),
c AS (SELECT doc_id, min(component) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN c ON s.doc_id = c.doc_id"""


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts hold the markers themselves."""
    text = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], rows.schema)
    return op1_chat.digests(op1_chat.format_conversations(rows.unionByName(own)))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_mixing.mix(table(spark, sf_dir, "documents"))


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_packing.pack(spread_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every vector whose id is divisible by 50."""
    return op4_topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_lines.dedup_lines(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_jaccard.jaccard_components(spread_table(spark, sf_dir, "documents", "doc_id", "text"), op6_jaccard.JaccardParams(width=4, num=85))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items found in it: ids, and the best similarity."""
    found = op7_decontaminate.leaks(spread_table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.size("leaks").alias("n_items"), F.col("leaks.item_id").alias("item_ids"), F.array_max("leaks.similarity").alias("similarity"),
        F.col("leaks.first_word").alias("first_words"), (F.size("leaks") > 0).alias("contaminated"),
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_quality.quality(spread_table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))


def op9_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op9_token_counts.prefix_tokens(spread_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), budget=2048)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licenses found in it, by place, and how much of each template matched."""
    found = op10_licenses.scan_licenses(spread_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", F.size("licenses").alias("n_licenses"), F.col("licenses.license").alias("licenses"), F.col("licenses.coverage").alias("coverage"),
        F.col("licenses.first_byte").alias("first_bytes"), F.col("licenses.end_byte").alias("end_bytes"),
    )


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_chat_formatting, op2_source_mixing, op3_token_packing, op4_exact_top_k, op5_line_dedup, op6_ngram_jaccard_join, op7_benchmark_decontamination,
        op8_quality_classifier, op9_prefix_token_counts, op10_license_scan,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": CHAT_SQL, "op4_exact_top_k": TOP_K_SQL, "op5_line_dedup": LINES_SQL, "op6_ngram_jaccard_join": JACCARD_SQL}
