"""Nucleic and protein sequence functions as native column expressions. Coordinates are 0-based, half-open."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes and their complements, in the same order.
IUPAC, COMPLEMENT = "ACGTURYSWKMBDHVN", "TGCAAYRSWMKVHDBN"
# The standard genetic code, codons in TCAG order.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]
# Recognition sequence and cut on the top strand.
ENZYMES = {"BamHI": ("GGATCC", 1), "EcoRI": ("GAATTC", 1), "EcoRV": ("GATATC", 3), "HaeIII": ("GGCC", 2), "HindIII": ("AAGCTT", 1), "KpnI": ("GGTACC", 5), "NotI": ("GCGGCCGC", 2), "PstI": ("CTGCAG", 5), "SmaI": ("CCCGGG", 3), "XhoI": ("CTCGAG", 1)}
# Hydropathy of amino acids (Kyte and Doolittle).
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
# Letters of the IUPAC codes as four-bit sets of bases.
MASKS = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15}


def sanitize(seq: Column) -> Column:
    """Upper case, without white space and digits."""
    return F.regexp_replace(F.upper(seq), r"[\s0-9]", "")


def complement(seq: Column) -> Column:
    """Complement as DNA (U counts as T); letters outside IUPAC become N."""
    return F.translate(F.regexp_replace(F.upper(seq), f"[^{IUPAC}]", "N"), IUPAC, COMPLEMENT)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def reverse_complement_text(seq: str) -> str:
    """reverse_complement of one upper-case text."""
    pairs = dict(zip(IUPAC, COMPLEMENT, strict=True))
    return "".join(pairs.get(c, "N") for c in reversed(seq))


def _count(seq: Column, letters: str) -> Column:
    return F.length(F.regexp_replace(seq, f"[^{letters}]", ""))


def gc_percent(seq: Column) -> Column:
    """S counts as GC, W as AT; other ambiguous letters as neither. 0 without any countable base."""
    gc, at = _count(seq, "GCS"), _count(seq, "ATUW")
    return F.when(gc + at > 0, F.lit(100.0) * gc / (gc + at)).otherwise(F.lit(0.0))


def codons(seq: Column, frame: int = 0) -> Column:
    """Whole codons from frame on, in one pass over the text."""
    return F.regexp_extract_all(F.substr(seq, F.lit(frame + 1)), F.lit("(.{3})"), 1)


def gc3_percent(seq: Column) -> Column:
    """GC percent of third codon positions."""
    return gc_percent(F.array_join(F.transform(codons(seq), lambda c: F.substr(c, F.lit(3), F.lit(1))), ""))


#: IUPAC letters by their set of bases, 1 to 15; and the amino acid of each three sets, where all their codons agree.
_BY_MASK = "".join(next(c for c in "ACGTRYSWKMBDHVN" if MASKS[c] == m) for m in range(1, 16))


def _agreed(masks: tuple[int, int, int]) -> str:
    sets = [[b for b in "TCAG" if MASKS[b] & m] for m in masks]
    found = {CODE[CODONS.index(a + b + c)] for a in sets[0] for b in sets[1] for c in sets[2]}
    return found.pop() if len(found) == 1 else "X"


_AGREED = "".join(_agreed((a, b, c)) for a in range(16) for b in range(16) for c in range(16))


def amino_acid(codon: Column) -> Column:
    """The amino acid of a codon, * for a stop; of an ambiguous one that on which all its codons agree. Else NULL."""
    letter = lambda k: F.instr(F.lit(_BY_MASK), F.replace(F.substr(codon, F.lit(k), F.lit(1)), F.lit("U"), F.lit("T")))
    found = F.substr(F.lit(_AGREED), letter(1) * 256 + letter(2) * 16 + letter(3) + 1, F.lit(1))
    return F.when((F.length(codon) == 3) & (F.translate(codon, _BY_MASK + "U", "") == "") & (found != "X"), found)


def translate(seq: Column, frame: int = 0) -> Column:
    """Protein of one frame; * is a stop, X a codon whose meanings differ or with other letters."""
    return F.array_join(F.transform(codons(seq, frame), lambda c: F.coalesce(amino_acid(c), F.lit("X"))), "")


_LETTER = np.zeros(256, np.uint8)
_LETTER[[ord(c) for c in MASKS]] = list(MASKS.values())
_PROTEIN = np.frombuffer(_AGREED.encode(), np.uint8)


def translate_bytes(seq: bytes, frame: int = 0) -> str:
    """translate for one text: a lookup a letter and one a codon, over the whole text at once."""
    own = _LETTER[np.frombuffer(seq, np.uint8)[frame:]]
    n = len(own) // 3
    own = own[: 3 * n].reshape(n, 3).astype(np.int64)
    return _PROTEIN[own @ np.array([256, 16, 1])].tobytes().decode("ascii")


def translated(seq: Column, frame: int = 0) -> Column:
    """translate in Arrow batches, for long texts: the native form costs an interpreted step for each codon."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else translate_bytes(t.encode("ascii", "replace"), frame))

    return run(seq)


def six_frames(seq: Column) -> dict[str, Column]:
    back = reverse_complement(seq)
    return {f"{s}{k + 1}": translated(seq if s == "f" else back, k) for s in "fr" for k in range(3)}


def iupac_regex(pattern: str) -> str:
    """A lookahead that matches wherever pattern does; a code accepts exactly the bases that it stands for."""
    letters = {m: "".join(b for b in "ACGT" if MASKS[b] & m) for m in range(1, 16)}
    return "(?=" + "".join(f"[{letters[MASKS[c]]}]" for c in pattern.upper()) + ")"


def find_pattern(seq: Column, pattern: str, circular: bool = False) -> Column:
    """0-based starts of all matches, overlapping ones too; on a circle a match may wrap.

    The text is split before each match, in one pass; lengths of the parts add up to the starts.
    """
    m = len(pattern)
    whole = F.concat(seq, F.left(seq, F.lit(m - 1))) if circular else seq
    parts = F.split(whole, iupac_regex(pattern))
    sizes = F.transform(F.slice(parts, 1, F.size(parts) - 1), F.length)
    step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["starts"], F.array(s["at"] + n)).alias("starts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    first = F.when(F.regexp_like(whole, F.lit("^" + iupac_regex(pattern))), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.concat(first, F.aggregate(sizes, start, step, lambda s: s["starts"]))


def fragments(sites: Column, cut: int, length: Column, circular: bool = False) -> Column:
    """Fragment lengths of a digest, in order; their sum is the length. Cuts at the ends of a line don't count."""
    where = F.transform(sites, lambda s: s + cut)
    if circular:
        cuts = F.array_sort(F.array_distinct(F.transform(where, lambda c: F.pmod(c, length))))
        ends = F.concat(F.slice(cuts, 2, F.greatest(F.size(cuts) - 1, F.lit(0))), F.array(F.get(cuts, F.lit(0)) + length))
        return F.when(F.size(cuts) == 0, F.array(length)).otherwise(F.zip_with(cuts, ends, lambda a, b: b - a))
    cuts = F.array_sort(F.array_distinct(F.filter(where, lambda c: (c > 0) & (c < length))))
    return F.zip_with(F.concat(F.array(F.lit(0)), cuts), F.concat(cuts, F.array(length)), lambda a, b: b - a)


def longest_run(seq: Column) -> Column:
    """Length of the longest run of one base."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(seq, F.lit("(A+|C+|G+|T+)"), 1), F.length)), F.lit(0))


def gravy(protein: Column) -> Column:
    """Mean hydropathy over known residues; NULL without any."""
    total = sum((F.lit(v) * _count(protein, a) for a, v in HYDROPATHY.items()), F.lit(0.0))
    return total / F.nullif(_count(protein, "".join(HYDROPATHY)), F.lit(0))


def extinction_280(protein: Column) -> Column:
    """Molar extinction at 280 nm, cystines counted as paired."""
    return 5500 * _count(protein, "W") + 1490 * _count(protein, "Y") + 125 * F.floor(_count(protein, "C") / 2)


def aliphatic_index(protein: Column) -> Column:
    a, v, il = _count(protein, "A"), _count(protein, "V"), _count(protein, "IL")
    return F.lit(100.0) * (a + F.lit(2.9) * v + F.lit(3.9) * il) / F.nullif(F.length(protein), F.lit(0))


# Side-chain and terminal pK values (Bjellqvist).
PK_BASIC = {"K": 10.0, "R": 12.0, "H": 5.98}
PK_ACID = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
PK_N_TERMINUS, PK_C_TERMINUS = 7.5, 3.55


def net_charge(protein: Column, ph: Column) -> Column:
    """Charge of a protein at a pH by the Henderson-Hasselbalch terms of its residues and ends."""
    up = lambda pk: 1 / (1 + F.pow(F.lit(10.0), ph - pk))
    down = lambda pk: 1 / (1 + F.pow(F.lit(10.0), pk - ph))
    plus = sum((_count(protein, a) * up(pk) for a, pk in PK_BASIC.items()), up(PK_N_TERMINUS))
    return plus - sum((_count(protein, a) * down(pk) for a, pk in PK_ACID.items()), down(PK_C_TERMINUS))


def isoelectric_point(counts: dict[str, Column]) -> Column:
    """pI by 60 bisections on pH 2 to 13, from residue counts (K, R, H, D, E, C, Y)."""

    def charge(ph: Column) -> Column:
        up = lambda pk: 1 / (1 + F.pow(F.lit(10.0), ph - pk))
        down = lambda pk: 1 / (1 + F.pow(F.lit(10.0), pk - ph))
        plus = sum((counts[a] * up(pk) for a, pk in PK_BASIC.items()), up(PK_N_TERMINUS))
        return plus - sum((counts[a] * down(pk) for a, pk in PK_ACID.items()), down(PK_C_TERMINUS))

    def halve(state: Column, _: Column) -> Column:
        middle = (state["lo"] + state["hi"]) / 2
        return F.when(charge(middle) > 0, F.struct(middle.alias("lo"), state["hi"].alias("hi"))).otherwise(F.struct(state["lo"].alias("lo"), middle.alias("hi")))

    start = F.struct(F.lit(2.0).alias("lo"), F.lit(13.0).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
