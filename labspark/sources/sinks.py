"""Writers: run records, GenBank records, simulated plates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labspark.kernels.fit import logistic4


def append_runs(runs: DataFrame, path: str) -> DataFrame:
    """Appends run records (kind, subject, summary, status) to a Parquet table, numbered on from its last id.

    One writer at a time, as for any numbered journal. A missing status is 'complete'. Returns
    what was written.
    """
    spark = runs.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    last = spark.read.parquet(path).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if there else 0
    number = F.row_number().over(Window.orderBy("kind", "subject", "summary"))
    rows = runs.select((number + F.lit(last)).cast("long").alias("id"), "kind", "subject", F.coalesce("status", F.lit("complete")).alias("status"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm").alias("created_at"), "summary")
    rows.coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path).filter(F.col("id") > last)


def format_location(parts: list[tuple[int, int, bool]]) -> str:
    """The text of a feature's parts, in the order that parse_location gives back."""
    one = lambda a, b: f"{a + 1}..{b}" if b - a > 1 else str(a + 1)
    if parts and all(r for _, _, r in parts):
        inner = format_location([(a, b, False) for a, b, _ in reversed(parts)])
        return f"complement({inner})"
    texts = [f"complement({one(a, b)})" if r else one(a, b) for a, b, r in parts]
    return texts[0] if len(texts) == 1 else f"join({','.join(texts)})"


def format_genbank(record: dict) -> str:
    """A GenBank record as text, in the fields of parse_genbank."""
    seq = record["seq"].lower()
    out = [f"LOCUS       {record['locus']} {len(seq)} bp    DNA     {'circular' if record['circular'] else 'linear'}", f"DEFINITION  {record['definition']}", "FEATURES             Location/Qualifiers"]
    for f in record["features"]:
        out.append(f"     {f['kind']:<16}{format_location([tuple(p.values()) if isinstance(p, dict) else tuple(p) for p in f['parts']])}")
        for k, v in f["qualifiers"].items():
            out.append(f'                     /{k}="{v}"' if v else f"                     /{k}")
    out.append("ORIGIN")
    for at in range(0, len(seq), 60):
        line = seq[at : at + 60]
        out.append(f"{at + 1:>9} " + " ".join(line[i : i + 10] for i in range(0, len(line), 10)))
    return "\n".join([*out, "//", ""])


def simulated_plate(spark: SparkSession, truth: list[float], conc: list[float], replicates: int, sd: float, seed: int) -> DataFrame:
    """Rows of a long plate table: a curve's wells by concentration and replicate, with controls in the outer columns."""
    rng, rows = np.random.default_rng(seed), []
    for r in range(replicates):
        name = chr(65 + r)
        for c, x in enumerate(conc):
            y = float(logistic4(np.array([np.log10(x)]), np.array(truth))[0] + rng.normal(0, sd))
            rows.append(("SIM", f"{name}{c + 2}", "sample", "S1", float(x), y))
        rows.append(("SIM", f"{name}1", "positive", "", None, float(truth[0] + rng.normal(0, sd))))
        rows.append(("SIM", f"{name}{len(conc) + 2}", "negative", "", None, float(truth[3] + rng.normal(0, sd))))
    return spark.createDataFrame(rows, "Plate_ID string, Well string, Role string, Sample_ID string, Concentration double, Readout double")
