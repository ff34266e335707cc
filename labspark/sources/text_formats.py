"""Readers and writers of laboratory text formats: FASTA, GMT, PDB, plate tables, packs.

Line formats are read by Spark's text reader and parsed natively; formats whose records
span many lines are read a record at a time by their separator or, where a file is one
document, whole.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_fasta(spark: SparkSession, path: str, nucleic: bool = False) -> DataFrame:
    """id, description, seq, dropped (characters outside the alphabet) of each record; large files split at '>'."""
    record = spark.read.option("lineSep", ">").text(path).filter(F.col("value").rlike(r"\S"))
    header, body = F.substring_index("value", "\n", 1), F.expr("substring(value, instr(value, '\n') + 1)")
    raw = F.regexp_replace(F.upper(body), r"\s", "")
    keep = "ACGTURYSWKMBDHVN" if nucleic else "ACDEFGHIKLMNPQRSTVWYBXZUO*-"
    rows = record.select(F.regexp_replace(header, "\r", "").alias("header"), raw.alias("raw"))
    seq = F.regexp_replace("raw", f"[^{re.escape(keep)}]", "")
    rows = rows.select(F.substring_index("header", " ", 1).alias("id"), F.trim(F.expr("substring(header, length(substring_index(header, ' ', 1)) + 1)")).alias("description"), seq.alias("seq"), (F.length("raw") - F.length(seq)).alias("dropped"))
    return rows.withColumns({"organism": F.nullif(F.regexp_extract("description", r"OS=(.*?)(?: [A-Z]{2}=|$)", 1), F.lit("")), "accession": F.nullif(F.regexp_extract("id", r"^(?:sp|tr)\|([^|]+)\|", 1), F.lit(""))})


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    """Records of id, description and seq, the sequence in lines of width."""
    lines = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    head = F.concat(F.lit(">"), F.trim(F.concat_ws(" ", "id", "description")))
    df.select(F.concat(head, F.lit("\n"), lines).alias("value")).write.text(path)


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """id, title, member: a row for each distinct member; lines that start with # are notes."""
    lines = spark.read.text(path).filter("value NOT LIKE '#%' AND length(trim(value)) > 0")
    parts = F.split("value", "\t")
    # Names with spaces stand in the title column, whichever of the first two it is.
    swapped = parts[0].contains(" ") & ~parts[1].contains(" ") & (F.length(parts[1]) > 0)
    rows = lines.select(F.when(swapped, parts[1]).otherwise(parts[0]).alias("id"), F.when(swapped, parts[0]).otherwise(parts[1]).alias("title"), F.explode(F.array_distinct(F.filter(F.slice(parts, 3, 1 << 20), lambda m: F.length(F.trim(m)) > 0))).alias("member"))
    return rows.withColumn("member", F.trim("member"))


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """A row for each ATOM and HETATM of each file, with model numbers; fixed columns, natively cut.

    Lines are numbered within their file, which is one structure, so the model is a running
    count over that file alone.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("structure"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    model = F.greatest(F.lit(1), F.sum(F.col("line").startswith("MODEL").cast("int")).over(Window.partitionBy("structure").orderBy("line_no")))
    rows = text.withColumn("model", model).filter(F.col("line").startswith("ATOM") | F.col("line").startswith("HETATM"))
    cut = lambda a, b: F.trim(F.substring("line", a, b - a + 1))
    number = lambda a, b: F.expr(f"try_cast(trim(substring(line, {a}, {b - a + 1})) AS double)")
    element = F.when(F.length(cut(77, 78)) > 0, cut(77, 78)).otherwise(F.regexp_extract(cut(13, 16), "[A-Za-z]", 0))
    return rows.select(
        "structure", "model", number(7, 11).cast("int").alias("serial"), cut(13, 16).alias("name"), cut(17, 17).alias("altloc"), cut(18, 20).alias("resname"), cut(22, 22).alias("chain"),
        number(23, 26).cast("int").alias("auth_seq"), cut(27, 27).alias("icode"), number(31, 38).alias("x"), number(39, 46).alias("y"), number(47, 54).alias("z"),
        number(55, 60).alias("occupancy"), number(61, 66).alias("b"), F.upper(element).alias("element"), F.col("line").startswith("HETATM").alias("het"),
    )


CIF = "structure string, model int, serial int, name string, altloc string, resname string, chain string, auth_seq int, icode string, x double, y double, z double, occupancy double, b double, element string, het boolean"
_CIF_TOKEN = re.compile(r"'(?:[^'\n]|'(?=\S))*'|\"(?:[^\"\n]|\"(?=\S))*\"|^;.*?^;|#[^\n]*|\S+", re.S | re.M)


def parse_cif(text: str) -> list[dict[str, str]]:
    """Rows of the _atom_site loop, as texts by column."""
    tokens = [t for t in _CIF_TOKEN.findall(text) if not t.startswith("#")]
    rows, i = [], 0
    while i < len(tokens):
        if tokens[i].lower() != "loop_":
            i += 1
            continue
        i += 1
        names = []
        while i < len(tokens) and tokens[i].startswith("_"):
            names.append(tokens[i].lower())
            i += 1
        if not names or not names[0].startswith("_atom_site."):
            continue
        while i + len(names) <= len(tokens) and not tokens[i].startswith("_") and tokens[i].lower() not in ("loop_",) and not tokens[i].lower().startswith("data_"):
            values = [t[1:-1] if t[0] in "'\"" and len(t) > 1 else t for t in tokens[i : i + len(names)]]
            rows.append({n.split(".")[1]: ("" if v in (".", "?") else v) for n, v in zip(names, values, strict=True)})
            i += len(names)
    return rows


def read_cif(spark: SparkSession, path: str) -> DataFrame:
    """The atoms of mmCIF files, in the columns of read_pdb; author chain and numbers go before label ones."""
    fields = [f.split()[0] for f in CIF.split(", ")]

    def number(v: str | None, kind):
        try:
            return kind(float(v)) if v else None
        except ValueError:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, text in zip(batch["structure"], batch["value"], strict=True):
                out = [(
                    name, number(r.get("pdbx_pdb_model_num") or "1", int), number(r.get("id"), int), r.get("auth_atom_id") or r.get("label_atom_id"), r.get("label_alt_id", ""), r.get("auth_comp_id") or r.get("label_comp_id"),
                    r.get("auth_asym_id") or r.get("label_asym_id"), number(r.get("auth_seq_id") or r.get("label_seq_id"), int), r.get("pdbx_pdb_ins_code", ""), number(r.get("cartn_x"), float), number(r.get("cartn_y"), float),
                    number(r.get("cartn_z"), float), number(r.get("occupancy"), float), number(r.get("b_iso_or_equiv"), float), (r.get("type_symbol") or "").upper(), r.get("group_pdb", "").upper() == "HETATM",
                ) for r in parse_cif(text)]
                yield pd.DataFrame(out, columns=fields)

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("structure"), "value").mapInPandas(run, CIF)


GENBANK = "locus string, length int, circular boolean, definition string, seq string, features array<struct<kind: string, location: string, parts: array<struct<start: int, stop: int, reverse: boolean>>, qualifiers: map<string, string>>>, warnings array<string>"


def parse_location(text: str, reverse: bool = False) -> list[tuple[int, int, bool]]:
    """0-based half-open parts of a feature location, in reading order; partial marks are read over."""
    text = text.strip()
    for word in ("complement", "join", "order"):
        if text.startswith(word + "(") and text.endswith(")"):
            inner, parts, depth, now = text[len(word) + 1 : -1], [], 0, ""
            for c in inner:
                depth += (c == "(") - (c == ")")
                if c == "," and depth == 0:
                    parts.append(now)
                    now = ""
                else:
                    now += c
            flip = reverse != (word == "complement")
            out = [p for part in [*parts, now] for p in parse_location(part, flip)]
            return out[::-1] if word == "complement" else out
    m = re.fullmatch(r"<?(\d+)(?:\.\.>?(\d+)|\^(\d+))?", text)
    if not m:
        raise ValueError(f"location {text!r}")
    return [(int(m[1]) - 1, int(m[2] or m[1]), reverse)]


def parse_genbank(text: str) -> dict:
    """One GenBank record; what can't be read is named in warnings."""
    out: dict = {"locus": None, "length": None, "circular": False, "definition": "", "seq": "", "features": [], "warnings": []}
    section, feature, key = "", None, None
    for line in text.splitlines():
        if line.startswith("LOCUS"):
            f = line.split()
            out["locus"], out["length"], out["circular"] = f[1], int(f[2]) if len(f) > 2 and f[2].isdigit() else None, "circular" in line
        elif line.startswith("DEFINITION"):
            section, out["definition"] = "definition", line[12:].strip()
        elif line.startswith("FEATURES"):
            section = "features"
        elif line.startswith("ORIGIN"):
            section = "origin"
        elif line[:1].strip():
            section = ""
        elif section == "definition":
            out["definition"] += " " + line.strip()
        elif section == "origin":
            out["seq"] += re.sub(r"[\s\d]", "", line).upper()
        elif section == "features" and line[5:6].strip():
            kind, _, where = line.strip().partition(" ")
            feature, key = {"kind": kind, "location": where.strip(), "parts": [], "qualifiers": {}}, None
            out["features"].append(feature)
        elif section == "features" and feature is not None:
            body = line.strip()
            if body.startswith("/"):
                key, _, value = body[1:].partition("=")
                feature["qualifiers"][key] = value.strip('"')
            elif key is None:
                feature["location"] += body
            else:
                glue = "" if key == "translation" else " "
                feature["qualifiers"][key] += glue + body.strip('"')
    for f in out["features"]:
        try:
            f["parts"] = [{"start": a, "stop": b, "reverse": r} for a, b, r in parse_location(f["location"])]
        except ValueError as e:
            out["warnings"].append(str(e))
    return out


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record, split at the // line."""
    names = ["locus", "length", "circular", "definition", "seq", "features", "warnings"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse_genbank(t) for t in batch["value"] if "LOCUS" in t], columns=names)

    return spark.read.option("lineSep", "\n//").text(path).mapInPandas(run, GENBANK)


WELLS = "plate string, row int, col int, well string, role string, value double, conc double, sample_id string, excluded boolean, metadata map<string, string>, warnings array<string>"
# Spellings of the well roles.
ROLES = {"sample": "sample", "compound": "sample", "test": "sample", "positive": "positive", "pos": "positive", "positive_control": "positive", "max": "positive", "high": "positive", "negative": "negative", "neg": "negative", "negative_control": "negative", "vehicle": "negative", "min": "negative", "low": "negative", "dmso": "negative", "blank": "blank", "buffer": "blank", "reference": "reference", "ref": "reference", "empty": "empty", "unknown": "unknown", "na": "unknown", "": "unknown"}
_KNOWN = {"plate", "plate_id", "well", "role", "sample_id", "concentration", "conc", "readout", "value", "excluded"}


def well_position(name: str) -> tuple[int, int] | None:
    """0-based (row, column) of a well name; rows count A to Z, then AA."""
    m = re.fullmatch(r"([A-Za-z]{1,2})0*(\d{1,2})", name.strip())
    if not m or int(m[2]) < 1:
        return None
    row = 0
    for c in m[1].upper():
        row = row * 26 + ord(c) - 64
    return row - 1, int(m[2]) - 1


def parse_plate(text: str) -> list[dict]:
    """Wells of a long table or of grids, whichever the text holds. Figures that can't be read are NULL with a warning."""
    lines = text.replace("\r\n", "\n").split("\n")
    first = next((x for x in lines if x.strip()), "")
    mark = next((m for m in "\t,;" if m in first), ",")
    cells = [[c.strip().strip('"') for c in x.split(mark)] for x in lines]
    start = next((i for i, r in enumerate(cells) if any(r)), None)
    if start is None:
        return []

    def number(v: str, what: str, warnings: list[str]) -> float | None:
        try:
            return float(v) if v else None
        except ValueError:
            warnings.append(f"{what} {v!r} is no number")
            return None

    out = []
    head = [re.sub(r"[\s-]+", "_", h.lower()) for h in cells[start]]
    if "well" in head:
        for r in cells[start + 1 :]:
            if not any(r):
                continue
            row = dict(zip(head, r, strict=False))
            warnings: list[str] = []
            place = well_position(row.get("well", ""))
            if place is None:
                warnings.append(f"well {row.get('well')!r} has no position")
            role = row.get("role", "").lower().replace(" ", "_").replace("-", "_")
            if role not in ROLES:
                warnings.append(f"role {role!r} is unknown")
            value = number(row.get("readout", row.get("value", "")), "readout", warnings)
            out.append({
                "plate": row.get("plate_id", row.get("plate", "")), "row": place[0] if place else None, "col": place[1] if place else None, "well": row.get("well"), "role": ROLES.get(role, "unknown"), "value": value,
                "conc": number(row.get("concentration", row.get("conc", "")), "concentration", warnings), "sample_id": row.get("sample_id"), "excluded": value is None or row.get("excluded", "").lower() in ("1", "true", "yes"),
                "metadata": {k: v for k, v in row.items() if k not in _KNOWN and k}, "warnings": warnings,
            })
        return out
    plate, i = 0, start
    while i < len(cells):
        r = cells[i]
        if r and not r[0] and all(c.isdigit() for c in r[1:] if c) and any(r[1:]):
            plate, columns, i = plate + 1, [int(c) - 1 for c in r[1:] if c], i + 1
            while i < len(cells) and cells[i] and re.fullmatch(r"[A-Za-z]{1,2}", cells[i][0] or ""):
                row = well_position(cells[i][0] + "1")[0]
                for col, v in zip(columns, cells[i][1:], strict=False):
                    warnings = []
                    value = number(v, "readout", warnings)
                    out.append({"plate": str(plate), "row": row, "col": col, "well": f"{cells[i][0].upper()}{col + 1}", "role": "unknown", "value": value, "conc": None, "sample_id": None, "excluded": value is None, "metadata": {}, "warnings": warnings})
                i += 1
        else:
            i += 1
    return out


def read_plates(spark: SparkSession, path: str) -> DataFrame:
    """Wells of plate files, each read whole: a plate has at most 1536 wells."""
    names = [f.split()[0] for f in WELLS.replace("map<string, string>", "m").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                yield pd.DataFrame(parse_plate(text), columns=names)

    return spark.read.text(path, wholetext=True).mapInPandas(run, WELLS)


COMPOUNDS = "array<struct<id: string, name: string, smiles: string, drugClass: string, properties: string>>"
TARGETS = "array<struct<id: string, name: string, pdb: string, box: struct<cx: double, cy: double, cz: double, sx: double, sy: double, sz: double>>>"
PACK = f"schemaVersion int, id string, title string, compounds {COMPOUNDS}, targets {TARGETS}"


def read_packs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(packs, errors): valid JSON packs with their file, and every other file with what is wrong."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", PACK).alias("p"))
    ids = lambda c: F.coalesce(F.transform(F.col(f"p.{c}"), lambda x: x["id"]), F.array().cast("array<string>"))
    double = lambda c: F.size(ids(c)) > F.size(F.array_distinct(ids(c)))
    box = F.exists(F.coalesce("p.targets", F.array().cast(TARGETS)), lambda t: t["box"].isNotNull() & (t["pdb"].isNull() | (t["box"]["sx"] <= 0) | (t["box"]["sy"] <= 0) | (t["box"]["sz"] <= 0)))
    props = F.exists(F.coalesce("p.compounds", F.array().cast(COMPOUNDS)), lambda c: c["properties"].isNotNull())
    error = (
        F.when(F.col("p").isNull() | F.col("p.schemaVersion").isNull(), "no readable pack").when(F.col("p.schemaVersion") != 1, "schemaVersion must be 1").when(F.coalesce("p.id", F.lit("")) == "", "id is missing")
        .when(F.coalesce("p.title", F.lit("")) == "", "title is missing").when(double("compounds"), "a compound id occurs twice").when(double("targets"), "a target id occurs twice")
        .when(props, "properties are computed, not given").when(F.coalesce(box, F.lit(False)), "a box needs a structure and positive edges")
    )
    marked = raw.withColumn("error", error)
    return marked.filter("error IS NULL").select("file", "p.*"), marked.filter("error IS NOT NULL").select("file", "error")


def read_nucleic(spark: SparkSession, path: str) -> DataFrame:
    """Nucleic records of one format, told by the first line that is not blank: '>' is FASTA, 'LOCUS' GenBank; else ValueError."""
    first = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''").first()
    if first is not None and first["line"].startswith(">"):
        return read_fasta(spark, path, nucleic=True)
    if first is not None and first["line"].startswith("LOCUS"):
        return read_genbank(spark, path)
    raise ValueError(f"{path} is neither FASTA (a leading '>') nor GenBank (a leading 'LOCUS')")


#: Readers of structure files by extension, letter case aside.
STRUCTURES = {".pdb": read_pdb, ".ent": read_pdb, ".cif": read_cif, ".mmcif": read_cif}


def read_structure(spark: SparkSession, path: str) -> DataFrame | None:
    """The atoms of a structure file by the reader of its extension; None for any other extension."""
    read = STRUCTURES.get(posixpath.splitext(path)[1].lower())
    return read and read(spark, path)
