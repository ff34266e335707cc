"""Sequence queries over whole document texts as DNA."""

from __future__ import annotations

from pyspark.sql import functions as F

from labspark.functions import sequence as seq
from labspark.operators.biologics import LIABILITIES, liabilities
from labspark.operators import alignment_columns as cols
from labspark.operators import nucleic
from labspark.plans.views import SEQS, rounded, sequences

BACKGROUND = {"A": 0.3, "C": 0.2, "G": 0.2, "T": 0.3}


def _aligned(s, d):
    """Sequences in rows of sixty letters, a column block for each language."""
    lines = F.explode(F.regexp_extract_all("seq", F.lit("(.{1,60})"), 1)).alias("row")
    return sequences(s, d).select("lang", lines)


def _restriction(s, d):
    parts = [F.struct(F.lit(n).alias("enzyme"), seq.find_pattern(F.col("seq"), p).alias("sites")) for n, (p, _) in seq.ENZYMES.items()]
    rows = sequences(s, d).select("doc_id", F.explode(F.array(*parts)).alias("e"))
    return rows.select("doc_id", "e.enzyme", F.size("e.sites").alias("n_sites"), F.coalesce(F.get("e.sites", F.lit(0)), F.lit(-1)).alias("first_site"))


def _digest(s, d):
    pattern, cut = seq.ENZYMES["HaeIII"]
    rows = sequences(s, d).select("doc_id", F.length("seq").alias("n"), seq.fragments(seq.find_pattern(F.col("seq"), pattern), cut, F.length("seq")).alias("f"))
    return rows.select("doc_id", "n", F.size("f").alias("n_fragments"), F.array_max("f").alias("longest"), F.array_min("f").alias("shortest"), F.aggregate("f", F.lit(0), lambda a, x: a + x).alias("total"))


def _frames(s, d):
    rows = sequences(s, d)
    rows = rows.select("doc_id", *(v.alias(k) for k, v in seq.six_frames(F.col("seq")).items()))
    return rows.select("doc_id", *(F.md5(F.encode(c, "utf-8")).alias(c) for c in rows.columns[1:]), (F.length("f1") - F.length(F.replace("f1", F.lit("*"), F.lit("")))).alias("stops"))


def _motifs(s, d):
    rows = sequences(s, d).select("doc_id", seq.translated(F.col("seq")).alias("protein"))
    return liabilities(rows, "doc_id", "protein").groupBy("doc_id", "liability").agg(F.count("*").alias("n"), F.min("position").cast("int").alias("first"), F.min("motif").alias("motif"))


def _off_targets(s, d):
    """The first guide of each language against the sites of all sequences."""
    sites = nucleic.guide_sites(sequences(s, d).select("doc_id", "lang", "seq"), "doc_id", "seq")
    named = sites.join(sequences(s, d).select("doc_id", "lang"), "doc_id")
    guides = named.groupBy(F.col("lang").alias("guide_id")).agg(F.min("site").alias("guide"))
    found = nucleic.off_targets(guides, sites)
    return found.groupBy("guide_id", "guide", "mismatches").agg(F.count("*").alias("n"), F.sum("position").alias("positions"))


def _forbidden(s, d):
    return sequences(s, d).select("doc_id", F.array_join(nucleic.forbidden(F.col("seq"), ("GAATTC", "GGTCTC", "AATAAA"), 6), ",").alias("found"))


def _protein(s, d):
    rows = sequences(s, d).select("doc_id", F.replace(seq.translated(F.col("seq")), F.lit("*"), F.lit("")).alias("p")).filter("length(p) > 0")
    got = rows.select(
        "doc_id", seq.gravy(F.col("p")).alias("gravy"), seq.extinction_280(F.col("p")).alias("extinction"), seq.aliphatic_index(F.col("p")).alias("aliphatic"),
        seq.net_charge(F.col("p"), F.lit(7.0)).alias("charge"),
    )
    return rounded(rounded(got, "gravy", "aliphatic", places=9), "charge")


def _points_of_charge(s, d):
    """Isoelectric points; the charge falls with pH, so the bracket always closes on the same point."""
    rows = sequences(s, d).select("doc_id", seq.translated(F.col("seq")).alias("p"))
    n = {a: F.length("p") - F.length(F.replace("p", F.lit(a), F.lit(""))) for a in "KRHDECY"}
    rows = rows.select("doc_id", *(c.alias(f"n_{a}") for a, c in n.items()))
    return rounded(rows.select("doc_id", seq.isoelectric_point({a: F.col(f"n_{a}") for a in "KRHDECY"}).alias("pi")), "pi")


QUERIES = {
    "revcomp": lambda s, d: sequences(s, d).select("doc_id", F.md5(F.encode(seq.reverse_complement(F.col("seq")), "utf-8")).alias("digest"), F.length("seq").alias("n")),
    "gc": lambda s, d: rounded(sequences(s, d).select("doc_id", seq.gc_percent(F.col("seq")).alias("gc"), seq.gc3_percent(F.col("seq")).alias("gc3")), "gc", "gc3"),
    "codon_usage": lambda s, d: rounded(cols.codon_usage(sequences(s, d)), "weight"),
    "cai": lambda s, d: rounded(cols.cai(sequences(s, d), cols.codon_usage(sequences(s, d)), "doc_id"), "cai"),
    "six_frame": _frames,
    "restriction_sites": _restriction,
    "digest_fragments": _digest,
    "motif_scan": _motifs,
    "guide_offtargets": _off_targets,
    "forbidden_patterns": _forbidden,
    "protein_properties": _protein,
    "isoelectric_points": _points_of_charge,
    "homopolymer": lambda s, d: sequences(s, d).select("doc_id", seq.longest_run(F.col("seq")).alias("longest_run")),
    "column_entropy": lambda s, d: rounded(cols.column_entropy(_aligned(s, d), "lang"), "entropy"),
    "pssm": lambda s, d: rounded(cols.pssm(_aligned(s, d), "lang", BACKGROUND), "score"),
}

_MAP = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in zip(seq.CODONS, seq.CODE, strict=True)) + "}"


def _codons(x, frame=0):
    return f"regexp_extract_all({x}[{frame + 1}:], '(...)', 1)"


def _translate(x, frame=0):
    return f"coalesce(array_to_string(list_transform({_codons(x, frame)}, lambda c: coalesce({_MAP}[c], 'X')), ''), '')"


_BACK = "reverse(translate(seq, 'ACGT', 'TGCA'))"
_EACH = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS enzyme, len(string_split(seq, '{p}')) - 1 AS n_sites, strpos(seq, '{p}') - 1 AS first_site FROM seqs" for n, (p, _) in seq.ENZYMES.items())
_GC = "CASE WHEN length({0}) > 0 THEN 100.0::DOUBLE * length(regexp_replace({0}, '[^GC]', '', 'g')) / length({0}) ELSE 0.0::DOUBLE END"
_USAGE = f"""c AS (SELECT unnest({_codons("seq")}) AS codon FROM seqs), k AS (SELECT codon, count(*) AS n, {_MAP}[codon] AS aa FROM c GROUP BY codon),
usage AS (SELECT codon, n, aa, CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY aa) AS weight FROM k WHERE aa IS NOT NULL)"""
_ALIGNED = "aligned AS (SELECT lang, unnest(regexp_extract_all(seq, '(.{1,60})', 1)) AS row FROM seqs), letters AS (SELECT lang, i AS col, row[i + 1] AS residue FROM aligned, unnest(range(length(row))) AS u(i)), counts AS (SELECT lang, col, residue, count(*) AS n FROM letters GROUP BY ALL)"


def _n(letters):
    return f"length(regexp_replace(p, '[^{letters}]', '', 'g'))"


def _charge(ph):
    up = lambda pk: f"1 / (1 + pow(10::DOUBLE, {ph} - {pk}::DOUBLE))"
    down = lambda pk: f"1 / (1 + pow(10::DOUBLE, {pk}::DOUBLE - {ph}))"
    return up(seq.PK_N_TERMINUS) + "".join(f" + {_n(a)} * ({up(k)})" for a, k in seq.PK_BASIC.items()) + f" - {down(seq.PK_C_TERMINUS)}" + "".join(f" - {_n(a)} * ({down(k)})" for a, k in seq.PK_ACID.items())


ORACLES = {
    "revcomp": f"WITH {SEQS} SELECT doc_id, md5({_BACK}) AS digest, CAST(length(seq) AS INTEGER) AS n FROM seqs",
    "gc": f"WITH {SEQS}, t AS (SELECT doc_id, seq, coalesce(array_to_string(list_transform({_codons('seq')}, lambda c: c[3]), ''), '') AS s3 FROM seqs) SELECT doc_id, round({_GC.format('seq')}, 6) AS gc, round({_GC.format('s3')}, 6) AS gc3 FROM t",
    "codon_usage": f"WITH {SEQS}, {_USAGE} SELECT codon, n, aa, round(weight, 6) AS weight FROM usage",
    "cai": f"""WITH {SEQS}, {_USAGE}, d AS (SELECT doc_id, unnest({_codons("seq")}) AS codon FROM seqs)
SELECT doc_id, count(*) AS n_codons, round(exp(avg(ln(weight))), 6) AS cai FROM d JOIN usage USING (codon) WHERE aa NOT IN ('M', 'W', '*') GROUP BY doc_id""",
    "six_frame": f"""WITH {SEQS}, t AS (SELECT doc_id, seq, {_BACK} AS back FROM seqs)
SELECT doc_id, {', '.join(f"md5({_translate('seq' if s == 'f' else 'back', k)}) AS {s}{k + 1}" for s in 'fr' for k in range(3))}, CAST(length({_translate('seq')}) - length(replace({_translate('seq')}, '*', '')) AS INTEGER) AS stops FROM t""",
    "restriction_sites": f"WITH {SEQS}, e AS ({_EACH}) SELECT doc_id, enzyme, CAST(n_sites AS INTEGER) AS n_sites, CAST(first_site AS INTEGER) AS first_site FROM e",
    "digest_fragments": f"""WITH {SEQS}, c AS (SELECT doc_id, length(seq) AS n, list_transform(string_split(seq, 'GGCC'), lambda x: length(x)) AS parts FROM seqs),
f AS (SELECT doc_id, n, list_transform(parts, lambda x, i: x + CASE WHEN i > 1 THEN 2 ELSE 0 END + CASE WHEN i < len(parts) THEN 2 ELSE 0 END) AS f FROM c)
SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(len(f) AS INTEGER) AS n_fragments, CAST(list_max(f) AS INTEGER) AS longest, CAST(list_min(f) AS INTEGER) AS shortest, CAST(list_sum(f) AS INTEGER) AS total FROM f""",
    "guide_offtargets": f"""WITH {SEQS}, b AS (SELECT doc_id, lang, '+' AS strand, seq AS s FROM seqs UNION ALL SELECT doc_id, lang, '-', {_BACK} FROM seqs),
p AS (SELECT *, unnest(range(1, greatest(length(s) - 21, 1))) AS i FROM b), h AS (SELECT *, s[i : i + 19] AS site, CASE strand WHEN '+' THEN i - 1 ELSE length(s) - i - 19 END AS position FROM p WHERE s[i + 21 : i + 22] = 'GG'),
g AS (SELECT lang AS guide_id, min(site) AS guide FROM h GROUP BY lang), m AS (SELECT guide_id, guide, position, hamming(guide, site) AS mismatches FROM g, h)
SELECT guide_id, guide, CAST(mismatches AS INTEGER) AS mismatches, count(*) AS n, CAST(sum(position) AS BIGINT) AS positions FROM m WHERE mismatches <= 2 GROUP BY ALL""",
    "forbidden_patterns": f"""WITH {SEQS}, r AS (SELECT doc_id, seq, {_BACK} AS back, list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda x: length(x))) AS run FROM seqs)
SELECT doc_id, concat_ws(',', {', '.join(f"CASE WHEN contains(seq, '{p}') OR contains(back, '{p}') THEN '{p}' END" for p in ("GAATTC", "GGTCTC", "AATAAA"))}, CASE WHEN run > 6 THEN 'run:' || run END) AS found FROM r""",
    "motif_scan": f"""WITH {SEQS}, t AS (SELECT doc_id, {_translate('seq')} AS p FROM seqs), r(liability, pattern) AS (VALUES {', '.join(f"('{n}', '{p}')" for n, p in LIABILITIES.items())}),
f AS (SELECT doc_id, liability, p, pattern, regexp_extract_all(p, pattern) AS m FROM t, r WHERE liability <> 'free C' OR len(regexp_extract_all(p, 'C')) % 2 = 1)
SELECT doc_id, liability, len(m) AS n, CAST(length(regexp_extract(p, '^(.*?)(' || regexp_replace(pattern, '^\\^', '') || ')', 1)) * CAST(liability <> 'C-terminal K' AS INTEGER) + CASE WHEN liability = 'C-terminal K' THEN length(p) - 1 ELSE 0 END AS INTEGER) AS first, list_min(m) AS motif FROM f WHERE len(m) > 0""",
    "protein_properties": f"""WITH {SEQS}, t AS (SELECT doc_id, replace({_translate('seq')}, '*', '') AS p FROM seqs),
c AS (SELECT doc_id, p, {', '.join(f"{_n(a)} AS n{a}" for a in seq.HYDROPATHY)} FROM t WHERE length(p) > 0)
SELECT doc_id, round(({' + '.join(f"{v}::DOUBLE * n{a}" for a, v in seq.HYDROPATHY.items())}) / nullif({' + '.join(f"n{a}" for a in seq.HYDROPATHY)}, 0), 9) + 0.0::DOUBLE AS gravy,
  5500 * nW + 1490 * nY + 125 * (nC // 2) AS extinction, round(100.0::DOUBLE * (nA + 2.9::DOUBLE * nV + 3.9::DOUBLE * (nI + nL)) / length(p), 9) AS aliphatic,
  round({_charge('7.0::DOUBLE')}, 6) + 0.0::DOUBLE AS charge FROM c""",
    "homopolymer": f"WITH {SEQS} SELECT doc_id, CAST(coalesce(list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda x: length(x))), 0) AS INTEGER) AS longest_run FROM seqs",
    "column_entropy": f"WITH {SEQS}, {_ALIGNED}, t AS (SELECT *, sum(n) OVER (PARTITION BY lang, col) AS depth FROM counts) SELECT lang, CAST(col AS INTEGER) AS \"column\", CAST(depth AS BIGINT) AS depth, round(-sum(n / CAST(depth AS DOUBLE) * log2(n / CAST(depth AS DOUBLE))), 6) + 0.0::DOUBLE AS entropy FROM t GROUP BY lang, col, depth",
    "pssm": f"""WITH {SEQS}, {_ALIGNED}, d AS (SELECT lang, col, sum(n) AS depth FROM counts GROUP BY ALL), bg(residue, e) AS (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in BACKGROUND.items())})
SELECT d.lang, CAST(d.col AS INTEGER) AS "column", bg.residue, round(log2((coalesce(n, 0) + 0.05::DOUBLE) / (depth + 0.2::DOUBLE) / e), 6) + 0.0::DOUBLE AS score FROM d CROSS JOIN bg LEFT JOIN counts c ON c.lang = d.lang AND c.col = d.col AND c.residue = bg.residue""",
}
