"""Mixing sources to target weights, in DataFrame functions only.

A source's texts, in a pseudorandom but fixed order, form one stream of words that is cut
into blocks of a fixed length; a document lies on a few neighbouring blocks. Targets are
shares of the output by weight, capped at a multiple of the source. The output is a run of
slots, a block each, in shards of equal length. Every shard draws multinomial source
counts; shards late in the run hand surplus draws on to sources that fell short, so that
each source ends with exactly the slots its target asks for. A source's j-th slot is mapped
through a pseudorandom permutation of its block indices (one for each epoch, by the
swap-or-not construction, a bijection of any range), and blocks join slots by index.

Within an epoch a block is used once, so no word is used more often than there are epochs.
Nothing is keyed by source alone but tables of a row for each shard or hash bucket: the word
positions come from two-level prefix sums, over (source, bucket) and then within a bucket,
and the slots are made after those rows were dealt by (shard, source) to tasks of
task_slots each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labspark.llm._text import named
from labspark.session import materialise

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    """weights repeat over the sources in code-point order; share is of all words, cap of a source's.

    Hash buckets are the least number given or more, so that one holds bucket_rows rows or so.
    """

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    cap: int = 2
    block: int = 256
    shard_slots: int = 4096
    task_slots: int = 1 << 15
    most_tasks: int = 10_000
    buckets: int = 4096
    bucket_rows: int = 1 << 16
    rounds: int = 16
    seed: int = 20240601


def with_rows(docs: DataFrame, name: str = "mix-rows", *keep: str) -> DataFrame:
    """row, doc_id, source, size and a text hash for each row of docs (and keep), written once.

    row is unique; as it is written, retries of later jobs see the same values.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return materialise(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("hash"), *keep,
        ),
        name,
    )


def targets(rows: DataFrame, params: MixParams) -> DataFrame:
    """idx, source, source_size, target, blocks, slots and last (words of the last slot) by source.

    Weights go by code point of the source, null last. A target over cap times its source's
    words stops there, and the excess is shared anew by weight; sorted by cap over weight,
    the capped sources come first, so running sums give the level of the rest.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source; from here on the table has as many rows as there are sources.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*(F.lit(float(w)) for w in params.weights))
    table = sizes.withColumn("idx", F.row_number().over(by_name) - 1).withColumn("weight", F.get(weights, F.col("idx") % len(params.weights)))
    table = table.withColumn("most", (F.col("source_size") * params.cap).cast("double"))
    before = Window.orderBy(F.col("most") / F.col("weight"), "idx").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.lit(params.share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    table = table.withColumn("capped", left * F.col("weight") > F.col("most") * weight_left)
    total = F.lit(params.share) * F.sum("source_size").over(whole) - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(whole)
    free = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0.0)).over(whole)
    table = table.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(total * F.col("weight") / free))
    wanted, size, block = F.floor("target"), F.col("source_size"), F.lit(params.block)
    table = table.withColumn("blocks", F.ceil(size / block))
    table = table.withColumn("epochs", F.when(size > 0, F.floor(wanted / size)).otherwise(0)).withColumn("rest", wanted - F.col("epochs") * size)
    table = table.withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block))
    table = table.withColumn("last", F.when(F.col("rest") > 0, F.col("rest") - (F.ceil(F.col("rest") / block) - 1) * block).otherwise(block))
    return materialise(table.select("idx", "source", "source_size", "target", "blocks", "slots", "last"), "mix-targets")


def _unit(*cols: Column) -> Column:
    """A number in [0, 1) from a hash of cols."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def permuted(x: Column, n: Column, params: MixParams, *key: Column) -> Column:
    """x under a pseudorandom permutation of 0 to n - 1 that key selects (swap-or-not rounds)."""

    def step(now: Column, k: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(params.seed), k, *key), n) - now, n)
        swap = F.xxhash64(F.lit(params.seed + 1), k, *key, F.greatest(now, other)).bitwiseAND(F.lit(1).cast("long")) == 1
        return F.when(swap, other).otherwise(now)

    return F.aggregate(F.sequence(F.lit(1), F.lit(params.rounds)), x, step)


def shard_counts(table: DataFrame, params: MixParams) -> DataFrame:
    """shard, idx and n: the slots of each source in each output shard; by source they add up to slots."""
    spark = table.sparkSession
    total = int(table.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0])
    cells = 1 << 12
    running = F.sum("slots").over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = table.filter(F.col("slots") > 0).select("idx", "slots", (running / float(max(total, 1))).alias("hi"), ((running - F.col("slots")) / float(max(total, 1))).alias("lo"))
    lookup = parts.select("idx", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))).alias("cell"))
    draws = spark.range(total).select(F.floor(F.col("id") / params.shard_slots).alias("shard"), _unit(F.lit(params.seed + 2), F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    # An equal join on the cell finds the interval that holds the draw.
    drawn = draws.join(lookup, "cell").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).groupBy("shard", "idx").agg(F.count("*").alias("n"))
    drawn = materialise(drawn, "mix-draws")
    quota = table.select("idx", "slots")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("idx").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = materialise(
        drawn.withColumn("before", before).join(quota, "idx").select("shard", "idx", "n", F.least("n", F.greatest(F.lit(0).cast("long"), F.col("slots") - F.col("before"))).alias("kept")), "mix-kept"
    )
    short = quota.join(kept.groupBy("idx").agg(F.sum("kept").alias("have")), "idx", "left").select("idx", (F.col("slots") - F.coalesce("have", F.lit(0))).alias("n")).filter("n > 0")
    free = kept.filter("n > kept").groupBy("shard").agg(F.sum(F.col("n") - F.col("kept")).alias("n"))

    def numbered(df: DataFrame, key: str) -> DataFrame:
        """A row for each unit of n, numbered in the order of key; the surplus is a root of the draws' number."""
        first = F.coalesce(F.sum("n").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return df.withColumn("first", first).select(key, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("unit"))

    moved = numbered(free, "shard").join(numbered(short, "idx"), "unit").groupBy("shard", "idx").agg(F.count("*").alias("kept"))
    return kept.select("shard", "idx", "kept").unionByName(moved).groupBy("shard", "idx").agg(F.sum("kept").alias("n")).filter("n > 0")


def slots(table: DataFrame, params: MixParams) -> DataFrame:
    """shard, idx, epoch, block and words (used from its start) of every output slot."""
    counts = materialise(shard_counts(table, params), "mix-counts")
    total = int(table.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0])
    tasks = max(1, min(params.most_tasks, -(-total // params.task_slots)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("idx").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The window has a row a shard of each source; its rows are dealt anew before they become slots.
    dealt = counts.join(table.drop("source"), "idx").withColumn("first", before).repartition(tasks, "shard", "idx")
    each = dealt.select("*", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    each = each.withColumn("epoch", F.floor(F.col("slot") / F.col("blocks")))
    block = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), params, F.col("idx"), F.col("epoch"))
    return each.withColumn("block", block).select(
        "shard", "idx", "epoch", "block",
        F.when(F.col("slot") == F.col("slots") - 1, F.least(F.col("last"), F.lit(params.block))).otherwise(F.lit(params.block)).cast("long").alias("words"),
    )


def pieces(rows: DataFrame, table: DataFrame, params: MixParams) -> DataFrame:
    """row, shard, epoch, from_word and n_words: what each slot takes of each document."""
    buckets = max(params.buckets, 1 << (rows.count() // params.bucket_rows).bit_length())
    placed = rows.filter("size > 0").withColumn("bucket", F.pmod(F.xxhash64(F.lit(params.seed + 3), "doc_id", "hash"), F.lit(buckets)))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumn("offset", before).join(table.select("idx", F.col("source").alias("name")), F.col("source").eqNullSafe(F.col("name"))).select("idx", F.col("name"), F.col("bucket").alias("part"), "offset")
    offsets = materialise(offsets, "mix-offsets")
    inner = F.sum("size").over(Window.partitionBy("idx", "bucket").orderBy("doc_id", "hash", "size", "row").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("name")) & (F.col("bucket") == F.col("part"))).select(
        "row", "idx", "size", (F.col("offset") + F.coalesce(inner, F.lit(0))).alias("start")
    )
    b = F.lit(params.block)
    laid = placed.select("row", "idx", "size", "start", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * b)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * b + F.col("words"))
    # Slots are made by a generator, whose size adaptive execution takes for that of its input: never broadcast them.
    return laid.join(slots(table, params).hint("merge"), ["idx", "block"]).select("row", "shard", "epoch", (low - F.col("start")).alias("from_word"), (high - low).alias("n_words")).filter("n_words > 0")


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of docs.

    Null or wordless text: size 0, taken 0. A null source is a source, the last. Repeated rows
    are separate documents. No words at all: targets and taken are 0. A source's taken
    words are at most its target and miss it by less than a block.
    """
    rows = with_rows(docs)
    table = targets(rows, params)
    taken = pieces(rows, table, params).groupBy("row").agg(F.sum("n_words").alias("taken"))
    found = rows.select("row", "doc_id", "size", "source").join(taken, "row", "left")
    named = table.select(F.col("source").alias("name"), "source_size", "target")
    return found.join(named, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The mix as rows with the columns of docs: for each document and epoch, the words taken.

    A document that an epoch takes whole keeps its text; of others the text holds the taken
    runs of words with the white space after each. n_chars, where docs has it, follows the
    text. Documents that no slot takes are absent, as are texts without words.
    """
    extra = [c for c in docs.columns if c not in ("doc_id", "source")]
    packed = F.struct(*(named(c) for c in extra)).alias("kept")
    rows = with_rows(docs, "mix-docs", packed)
    table = targets(rows, params)
    slim = rows.drop("kept")
    runs = pieces(slim, table, params).groupBy("row", "epoch").agg(F.array_sort(F.collect_list(F.struct("from_word", "n_words"))).alias("runs"), F.sum("n_words").alias("n"))
    # A document has at most size / block + 2 runs an epoch.
    text = F.col("kept.text")
    tokens = F.regexp_extract_all(text, F.lit(rf"{WORD}[\x20\x09-\x0D]*"), 0)
    cut = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(F.col("tokens"), (r["from_word"] + 1).cast("int"), r["n_words"].cast("int")))), "")
    whole = F.col("n") == F.col("size")
    # Generated, as a projected column would be put into the lambda and split anew for each run.
    got = rows.join(runs, "row").select("*", F.explode(F.array(F.when(~whole, tokens))).alias("tokens")).withColumn("mixed", F.when(whole, text).otherwise(cut))
    out = {"doc_id": F.col("doc_id"), "source": F.col("source")} | {c: F.col("kept").getField(c) for c in extra} | {"text": F.col("mixed")}
    if "n_chars" in extra:
        out["n_chars"] = F.length("mixed").cast(docs.schema["n_chars"].dataType)
    return got.select(*(out[c].alias(c) for c in docs.columns))
