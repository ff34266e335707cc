"""Catalog, panel and rule operators: search, resolution, overlays, coverage, interactions, run records."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def search(catalog: DataFrame, query: str, limit: int | None = 25) -> DataFrame:
    """Entries whose name or class holds query, letter case aside, in catalog order (seq); limit is the feature."""
    found = catalog.filter(F.lower(F.concat_ws(" ", "name", "class")).contains(query.lower())).orderBy("seq")
    return found if limit is None else found.limit(limit)


def resolve(targets: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted text: the first target whose id or name equals it, else whose name starts with it.

    Equal keys join on the lower-cased text, prefixes on each prefix of a name, so neither
    needs all pairs. Texts without a target keep a row of NULLs.
    """
    keys = targets.select("id", "name", "seq", F.explode(F.array_distinct(F.array(F.lower(F.col("id").cast("string")), F.lower("name")))).alias("key")).withColumn("kind", F.lit(0))
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.left(F.lower("name"), n))).alias("key")
    prefixes = targets.filter(F.length("name") > 0).select("id", "name", "seq", cut).withColumn("kind", F.lit(1))
    best = F.min(F.struct("kind", "seq", "id", "name")).alias("best")
    hits = wanted.join(keys.unionByName(prefixes), F.lower("text") == F.col("key")).groupBy("text").agg(best)
    return wanted.join(hits, "text", "left").select("text", F.col("best.id").alias("id"), F.col("best.name").alias("name"), (F.col("best.kind") == 0).alias("exact"))


def overlay(packs: DataFrame, key: str = "pack_id", order: str = "load_seq") -> DataFrame:
    """The last version of each pack, at the place (position) of its first one."""
    last = F.max_by(F.struct(*[c for c in packs.columns if c != key]), order).alias("last")
    return packs.groupBy(key).agg(last, F.min(order).alias("position")).select(key, "last.*", "position")


def first_definitions(entries: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the first definition of each key wins, later ones are reported."""
    ranked = entries.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return ranked.filter("nth = 1").drop("nth"), ranked.filter("nth > 1")


def panel_coverage(panel: DataFrame, presets: DataFrame, declared: int | None = None) -> DataFrame:
    """Panel rows with their preset count; rows without any keep a reason. panel and presets share key."""
    counted = presets.groupBy("key").agg(F.count("*").alias("presets"))
    rows = panel.join(counted, "key", "left").withColumn("presets", F.coalesce("presets", F.lit(0)))
    return rows.withColumn("reason", F.when(F.col("presets") == 0, "no preset for this target"))


def coverage_summary(covered: DataFrame, declared: int) -> DataFrame:
    """screened, unscreened and panel_size, which is the declared size."""
    return covered.agg(F.sum((F.col("presets") > 0).cast("long")).alias("screened")).select("screened", (F.lit(declared) - F.col("screened")).alias("unscreened"), F.lit(declared).cast("long").alias("panel_size"))


#: Members of a block: a pair of blocks makes at most its square of rows, in parts of PART.
BLOCK, PART = 2048, 1 << 18


def interactions(inhibitors: DataFrame, substrates: DataFrame) -> DataFrame:
    """perpetrator, victim and the number of enzymes that the one inhibits and the other needs; never itself.

    Members that share all their enzymes, or a few, are alike in cost: members meet in blocks,
    whose pairs are counted by products of incidence matrices, so a pair is a row once, when it
    is whole, and only the blocks are shuffled. Blocks without a common enzyme don't meet.
    """
    spark = inhibitors.sparkSession
    n = 2 * spark.sparkContext.defaultParallelism
    a, b = (d.select("member", "enzyme").dropna().distinct() for d in (inhibitors, substrates))
    kinds = {c: a.schema[c].dataType for c in ("member", "enzyme")}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                got = pa.RecordBatch.from_struct_array(batch.column("rows")[row].values).sort_by([("enzyme", "ascending"), ("member", "ascending")])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, got.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(got)
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(row, 1), pa.array([sink.getvalue().to_pybytes()])], names=["block", "rows"])

    members = max(a.select("member").distinct().count(), b.select("member").distinct().count())
    # Small tables have blocks enough to keep all cores busy.
    blocks = max(-(-members // BLOCK), min(math.isqrt(n) + 1, members), 1)
    block = F.pmod(F.xxhash64("member"), F.lit(blocks)).cast("int")
    own = [d.groupBy(block.alias("block")).agg(F.collect_list(F.struct("enzyme", "member")).alias("rows")).mapInArrow(pack, "block int, rows binary") for d in (a, b)]
    known = [d.select(block.alias("block"), "enzyme").distinct() for d in (a, b)]
    meet = known[0].withColumnRenamed("block", "p").join(known[1].withColumnRenamed("block", "v"), "enzyme").select("p", "v").distinct()
    pairs = meet.join(own[0].select(F.col("block").alias("p"), F.col("rows").alias("ps")), "p").join(own[1].select(F.col("block").alias("v"), F.col("rows").alias("vs")), "v")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                p, v = (pa.ipc.open_stream(batch.column(c)[row].as_buffer()).read_all() for c in ("ps", "vs"))
                enzymes = pa.chunked_array([*p["enzyme"].chunks, *v["enzyme"].chunks]).combine_chunks().dictionary_encode()
                codes = enzymes.indices.to_numpy()
                (p_members, pi), (v_members, vi) = ((m.dictionary, m.indices.to_numpy()) for m in (t["member"].combine_chunks().dictionary_encode() for t in (p, v)))
                yield from _shared(p_members, pi, codes[: len(pi)], v_members, vi, codes[len(pi) :], len(enzymes.dictionary))

    kind = kinds["member"].simpleString()
    return pairs.select("ps", "vs").repartition(max(n, min(blocks * blocks, 64 * n))).mapInArrow(count, f"perpetrator {kind}, victim {kind}, enzymes long")


def _shared(p_members: pa.Array, pi: np.ndarray, pe: np.ndarray, v_members: pa.Array, vi: np.ndarray, ve: np.ndarray, n_enzymes: int) -> Iterator[pa.RecordBatch]:
    """Pairs with common enzymes, from incidence lists (member and enzyme numbers): products of a slice of enzymes at a time."""
    order = np.argsort(pi, kind="stable")
    pi, pe = pi[order], pe[order]
    rows = max(1, PART // max(1, len(v_members)))
    same = pa.compute.index_in(p_members, value_set=v_members).fill_null(-1).to_numpy(zero_copy_only=False)
    for at in range(0, len(p_members), rows):
        till = min(at + rows, len(p_members))
        i, j = np.searchsorted(pi, [at, till])
        used = np.unique(pe[i:j])
        total = np.zeros((till - at, len(v_members)), np.float32)
        place = np.full(n_enzymes, -1)
        for lo in range(0, len(used), 512):
            part = used[lo : lo + 512]
            place[:] = -1
            place[part] = np.arange(len(part))
            x, y = np.zeros((till - at, len(part)), np.float32), np.zeros((len(part), len(v_members)), np.float32)
            mine, theirs = place[pe[i:j]] >= 0, place[ve] >= 0
            x[pi[i:j][mine] - at, place[pe[i:j][mine]]] = 1
            y[place[ve[theirs]], vi[theirs]] = 1
            total += x @ y
        k = np.flatnonzero(same[at:till] >= 0)
        total[k, same[at:till][k]] = 0
        left, right = np.nonzero(total)
        if len(left):
            yield pa.RecordBatch.from_arrays([p_members.take(pa.array(left + at)), v_members.take(pa.array(right)), pa.array(total[left, right].astype(np.int64))], names=["perpetrator", "victim", "enzymes"])


def banded_notes(subjects: DataFrame, bands: DataFrame, value: str) -> DataFrame:
    """subjects with the note of the band (low <= value < high, of the same gene) that comes first, else a null note.

    Each row of subjects gets a row, repeats too. bands is a rule table of a few rows; the
    different pairs of gene and value meet it on the gene.
    """
    asked = subjects.select(F.col("gene").alias("g"), F.col(value).alias("v")).distinct()
    cond = (F.col("g") == F.col("gene")) & (F.col("v") >= F.col("low")) & (F.col("v") < F.col("high"))
    notes = asked.join(bands, cond).groupBy("g", "v").agg(F.min_by("note", "seq").alias("note"))
    return subjects.join(notes, (subjects["gene"] == F.col("g")) & (subjects[value] == F.col("v")), "left").drop("g", "v")


def recent_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    """The latest runs with their printed ids; limit is the feature."""
    return runs.orderBy(F.col("id").desc()).limit(limit).withColumn("run", F.format_string("run-%04d", F.col("id")))


def verdict_max(rows: DataFrame, key: str, verdict: Column, order: tuple[str, ...]) -> DataFrame:
    """The gravest verdict of each key, by its place in order."""
    rank = F.array_position(F.array(*(F.lit(v) for v in order)), verdict)
    return rows.groupBy(key).agg(F.get(F.array(*(F.lit(v) for v in order)), (F.max(rank) - 1).cast("int")).alias("verdict"))


def by_id(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id) with the name and seq of its first entry in catalog order; NULLs where there is none."""
    first = entries.groupBy("id").agg(F.min(F.struct("seq", "name")).alias("first"))
    return wanted.join(first, "id", "left").select("id", F.col("first.name").alias("name"), F.col("first.seq").alias("seq"))


def resolve_compounds(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """text, kind, id and name of each wanted text.

    A null or empty text is the active compound (kind 'active'); else the first entry in
    catalog order whose id or name equals it, letter case aside ('library'); any other text
    is taken as a structure to be read ('structure') and has no id.
    """
    keys = catalog.select("id", "name", "seq", F.explode(F.array_distinct(F.array(F.lower(F.col("id").cast("string")), F.lower("name")))).alias("key"))
    asked = wanted.select("text", F.lower("text").alias("key"))
    hits = asked.filter("key <> ''").distinct().join(keys, "key").groupBy("key").agg(F.min(F.struct("seq", "id", "name")).alias("best"))
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    kind = F.when(empty, "active").when(F.col("best").isNotNull(), "library").otherwise("structure")
    return asked.join(hits, "key", "left").select("text", kind.alias("kind"), F.col("best.id").alias("id"), F.col("best.name").alias("name"))


def dockable(targets: DataFrame, headline: bool = False) -> DataFrame:
    """Targets that have a box, in any order; with headline those alone that a pack marks so."""
    boxed = targets.filter(F.col("box").isNotNull())
    return boxed.filter(F.coalesce("headline", F.lit(False))) if headline else boxed


def concatenate(builtin: DataFrame, user: DataFrame) -> DataFrame:
    """Built-in packs, then the user's, by column name with origin (0 and 1); a column that one lacks is NULL there."""
    return builtin.withColumn("origin", F.lit(0)).unionByName(user.withColumn("origin", F.lit(1)), allowMissingColumns=True)


def position_label(position: Column, insertion: Column) -> Column:
    """A numbered position as text, with its insertion code after a point where it has one."""
    code = F.coalesce(insertion, F.lit(""))
    return F.concat(position.cast("string"), F.when(code != "", F.concat(F.lit("."), code)).otherwise(""))
