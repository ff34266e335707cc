"""Line dedup by a log-template tree, in DataFrame functions only.

A line is parsed to a fixed depth: its token count, then its leading tokens, lead to a leaf;
tokens with digits are variable fields from the start. Within a leaf a token is constant at
its place where two or more documents have it there, else a variable field; lines whose
constants agree share a template. A template that is constant enough and recurs across
documents is dropped: all its lines go, and the rest of each document stays in order.

Equal lines shrink to one row before tokens are spread out, and only for leaves that hold
different lines. Counts have map-side partial sums, and joins meet written tables, so that
adaptive execution can split a hot line or token. Texts are shuffled at most twice: lines
to crowded leaves, and documents to what they lose.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.session import discard, materialise


@dataclass(frozen=True)
class LineParams:
    """depth leading tokens; constant is the least share of constant tokens in a template.

    A template recurs in min_docs documents, or in short_docs with fewer than long_tokens
    tokens; lines under min_tokens tokens are left alone.
    """

    depth: int = 3
    constant: float = 0.5
    min_docs: int = 2
    short_docs: int = 10
    long_tokens: int = 10
    min_tokens: int = 3


def _lines(docs: DataFrame, params: LineParams) -> DataFrame:
    """doc (a hash of id and text), pos, masked, n, leaf and line (a hash of masked) of each line.

    Lines without digits and odd white space, nearly all, are taken as they are. Lines are
    spread out before they are parsed, so that parsing is compiled code.
    """
    odd = F.lit(r"[0-9\t\x0B-\r]|  |^ | $")
    space, field = F.lit(r"[\x20\x09-\x0D]+"), F.lit(r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+")
    mask = F.regexp_replace(F.trim(F.regexp_replace("l", space, F.lit(" "))), field, F.lit("<*>"))
    doc = F.xxhash64(F.col("doc_id").cast("long"), "text").alias("doc")
    split = docs.select(doc, F.posexplode(F.split("text", "\n")).alias("pos", "l"))
    masked = split.select("doc", "pos", F.when(F.regexp_like("l", odd), mask).otherwise(F.col("l")).alias("masked"))
    m = F.col("masked")
    n = F.when(m == "", 0).otherwise(F.octet_length(m) - F.octet_length(F.replace(m, F.lit(" "), F.lit(""))) + 1)
    counted = masked.select("doc", "pos", "masked", n.alias("n"))
    return counted.select("doc", "pos", "masked", "n", F.xxhash64("n", F.substring_index("masked", " ", params.depth)).alias("leaf"), F.xxhash64("masked").alias("line"))


def recurring_lines(docs: DataFrame, params: LineParams = LineParams()) -> tuple[DataFrame, DataFrame]:
    """Written tables: every line as doc, pos, masked, n, leaf and line; the line hashes whose template recurs."""
    # Written once, masked texts in a column that only crowded leaves read again.
    written = materialise(_lines(docs, params), "lines")
    lines = written.filter(F.col("n") >= params.min_tokens)
    slim = lines.drop("masked")
    once = materialise(slim.select("leaf", "line", "n", "doc").distinct().groupBy("leaf", "line", "n").agg(F.count("*").alias("docs")), "line-counts")
    crowded = materialise(once.groupBy("leaf").agg(F.count("*").alias("lines")).filter("lines > 1").select("leaf"), "leaves")
    # Tokens of the different lines of crowded leaves; a hot line is one row a task here.
    # At most 2^20 rows say which hash buckets hold a crowded leaf: few other texts reach the shuffle.
    bucket = lambda c: F.pmod(c, F.lit(1 << 20)).cast("int").alias("bucket")
    near = F.broadcast(crowded.select(bucket(F.col("leaf"))).distinct())
    near_texts = lines.select("leaf", "line", "masked", bucket(F.col("leaf"))).join(near, "bucket", "left_semi")
    texts = near_texts.groupBy("leaf", "line").agg(F.min("masked").alias("masked")).join(crowded, "leaf", "left_semi")
    tokens = texts.select("leaf", "line", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    tokens = materialise(tokens.select("line", F.xxhash64("leaf", "at", "token").alias("place"), (F.col("token") == "<*>").alias("variable")), "tokens")
    weighed = tokens.filter(~F.col("variable")).join(once.select("line", "docs"), "line")
    support = materialise(weighed.groupBy("place").agg(F.sum("docs").alias("support")).filter(f"support >= {params.min_docs}").select("place"), "support")
    marked = tokens.join(support.withColumn("known", F.lit(True)), "place", "left")
    constant = F.col("known").isNotNull() & ~F.col("variable")
    shapes = marked.groupBy("line").agg(
        F.bit_xor(F.when(constant, F.col("place")).otherwise(F.lit(0).cast("long"))).alias("shape"), F.sum(constant.cast("int")).alias("constants")
    )
    shapes = materialise(shapes, "shapes")
    discard(tokens, support, once, crowded)
    known = slim.select("leaf", "line", "n", "doc").distinct().join(shapes, "line", "left")
    template = F.xxhash64("leaf", F.coalesce("shape", "line"), F.col("shape").isNull())
    kept = F.col("constants").isNull() | (F.col("constants") >= params.constant * F.col("n"))
    by_template = known.filter(kept).select("line", "n", "doc", template.alias("template"))
    by_template = materialise(by_template, "templates")
    counts = by_template.select("template", "n", "doc").distinct().groupBy("template").agg(F.count("*").alias("docs"), F.max("n").alias("n"))
    recurs = F.when(F.col("n") >= params.long_tokens, F.col("docs") >= params.min_docs).otherwise(F.col("docs") >= params.short_docs)
    recurring = materialise(counts.filter(recurs).select("template"), "recurring")
    dropped = by_template.select("template", "line").distinct().join(recurring, "template", "left_semi").select("line").distinct()
    dropped = materialise(dropped, "dropped")
    discard(shapes, by_template, recurring)
    return written, dropped


def dedup_lines(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """doc_id, n_lines, n_dropped and text (the lines that stay, in order) of each row of docs.

    Null text: no lines, null text. Empty text: one empty line. Blank and very short lines
    stay. Repeated rows are one document and lose the same lines. White space within a line
    does not tell lines apart, nor do runs of characters with a digit. Texts are parsed
    whole, whatever their length; other columns of docs are not looked at, and an empty table
    gives an empty one. Lines and tokens are known by 64-bit hashes.
    """
    written, dropped = recurring_lines(docs, params)
    # A set, as repeated rows are one document.
    lost = written.select("doc", "pos", "line").join(dropped, "line", "left_semi").groupBy("doc").agg(F.collect_set("pos").alias("lost"))
    lost = materialise(lost, "lost")
    discard(written, dropped)
    doc = F.xxhash64(F.col("doc_id").cast("long"), "text").alias("doc")
    both = docs.select(F.col("doc_id").cast("long"), F.split("text", "\n").alias("lines"), doc).join(lost, "doc", "left")
    size = F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return both.select(
        "doc_id", size.alias("n_lines"), F.when(F.col("lost").isNotNull(), F.size("lost")).otherwise(0).alias("n_dropped"),
        F.when(F.col("lost").isNull(), F.array_join("lines", "\n")).otherwise(kept).alias("text"),
    )
