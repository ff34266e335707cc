"""Kernels over tables: Arrow-batched functions by row and by group, with refusals kept as NULLs and texts.

Rows are independent, so maps need no shuffle; fits take one group each, whose size the
experiment bounds (a curve, a titration).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.kernels import align as align_kernel
from labspark.kernels import chem, fit, network

def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to two tasks a core (by keys, where given), so that heavy rows of a small table don't meet in one task."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)


PROPS = "canonical string, formula string, mol_weight double, mono_mass double, heavy_atoms int, hbd int, hba int, rotatable int, rings int, aromatic_atoms int, charge int, fsp3 double, tpsa double, fingerprint array<long>, groups array<string>, error string"


def smiles_props(df: DataFrame, column: str = "smiles") -> DataFrame:
    """df with the struct props: each SMILES is parsed and perceived once for all its figures; a bad one has an error."""

    @F.pandas_udf(PROPS)
    def props(texts: pd.Series) -> pd.DataFrame:
        groups = {g: chem.Pattern(p) for g, p in chem.GROUPS.items()}
        names = [c.strip().split()[0] for c in PROPS.replace("array<long>", "a").replace("array<string>", "a").split(",")]
        rows = []
        for text in texts:
            try:
                mol = chem.molecule(text or "")
                rows.append({"canonical": chem.canonical_smiles(mol), **chem.descriptors(mol), "fingerprint": chem.fingerprint(mol), "groups": [g for g, p in groups.items() if p.matches(mol, 1)], "error": None})
            except chem.ChemError as e:
                rows.append({"error": str(e)})
        return pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    return spread(df).withColumn("props", props(F.col(column)))


def smarts_hits(df: DataFrame, patterns: dict[str, str], column: str = "smiles") -> DataFrame:
    """df with hits: the number of distinct matches of each pattern (NULL for a bad SMILES). A bad pattern raises here."""
    for p in patterns.values():
        chem.Pattern(p)

    @F.pandas_udf("map<string, int>")
    def count(texts: pd.Series) -> pd.Series:
        compiled = {k: chem.Pattern(p) for k, p in patterns.items()}
        out = []
        for text in texts:
            try:
                mol = chem.molecule(text or "")
                out.append({k: len(p.matches(mol)) for k, p in compiled.items()})
            except chem.ChemError:
                out.append(None)
        return pd.Series(out)

    return spread(df).withColumn("hits", count(F.col(column)))


def align_pairs(df: DataFrame, a: str, b: str, local: bool = False) -> DataFrame:
    """df with score, identity, matches, gaps and columns of the best alignment of two protein columns."""

    @F.pandas_udf("score long, identity double, matches int, gaps int, columns int")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        got = [align_kernel.align(p or "", q or "", local) for p, q in zip(x, y, strict=True)]
        return pd.DataFrame({"score": [g.score for g in got], "identity": [g.identity for g in got], "matches": [g.matches for g in got], "gaps": [g.gaps for g in got], "columns": [len(g.a) for g in got]})

    return df.withColumn("alignment", run(F.col(a), F.col(b))).select("*", "alignment.*").drop("alignment")


def fit_curves(points: DataFrame, key: str, model: str, x: str = "conc", y: str = "value") -> DataFrame:
    """Parameters by series: key, names, params, errors, ssr, aicc, n, refusal. model is a logistic4 or 5 or a kinetic law."""
    kind = points.schema[key].dataType.simpleString()

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=[x, y]).sort_values([x, y])  # a fixed order makes sums repeatable
        c, v = rows[x].to_numpy(float), rows[y].to_numpy(float)
        got = {"logistic4": fit.fit_4pl, "logistic5": fit.fit_5pl}[model](c, v) if model.startswith("logistic") else fit.fit_kinetics(c, v, model)
        return pd.DataFrame([{
            key: rows[key].iloc[0] if len(rows) else None, "names": list(got.names), "params": list(map(float, got.params)), "errors": None if got.errors is None else list(map(float, got.errors)),
            "ssr": got.ssr if got.ok else None, "aicc": got.aicc if got.ok and math.isfinite(got.aicc) else None, "n": got.n, "refusal": got.refusal or None,
        }])

    return spread(points.select(key, x, y), key).groupBy(key).applyInPandas(one, f"{key} {kind}, names array<string>, params array<double>, errors array<double>, ssr double, aicc double, n int, refusal string")


def b_score(wells: DataFrame) -> DataFrame:
    """plate, row, col, value and b_score: median polish of each plate (at most 200 sweeps), over its scaled MAD."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        (_, r), (_, c) = (np.unique(rows[k].to_numpy(), return_inverse=True) for k in ("row", "col"))
        left = np.full((r.max() + 1, c.max() + 1), np.nan)
        left[r, c] = rows["value"].to_numpy(float)
        for _ in range(200):
            across = np.nanmedian(left, axis=1, keepdims=True)
            left -= across
            down = np.nanmedian(left, axis=0, keepdims=True)
            left -= down
            if max(np.abs(across).max(), np.abs(down).max()) < 1e-12:
                break
        mad = 1.4826022185056018 * np.nanmedian(np.abs(left - np.nanmedian(left)))
        return pd.DataFrame({k: rows[k] for k in ("plate", "row", "col", "value")} | {"b_score": left[r, c] / mad if mad > 0 else np.nan})

    kind = wells.schema["plate"].dataType.simpleString()
    return spread(wells.select("plate", "row", "col", "value"), "plate").groupBy("plate").applyInPandas(one, f"plate {kind}, row int, col int, value double, b_score double")


def ssa_ensemble(spark, net: network.Network, t_end: float, replicates: int, seed: int) -> DataFrame:
    """replicate, species, count at t_end: every replicate has its own stream, so any split of the work agrees."""
    names = net.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch["id"]:
                end = net.gillespie(t_end, np.random.default_rng([seed, int(r)]))[1][-1]
                rows += [(int(r), s, float(v)) for s, v in zip(names, end, strict=True)]
            yield pd.DataFrame(rows, columns=["replicate", "species", "count"])

    return spread(spark.range(replicates)).mapInPandas(run, "replicate long, species string, count double")


def parameter_sweep(df: DataFrame, net: network.Network, reaction: int, parameter: str, value: str, t_end: float) -> DataFrame:
    """df with end (amounts by species) after replacing one rate constant by each row's value."""

    @F.pandas_udf("map<string, double>")
    def run(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            net.reactions[reaction].params[parameter] = float(v)
            end = network.stiff(net.rhs, net.jacobian, net.start, 0.0, t_end)[1][-1]
            out.append(dict(zip(net.names, map(float, end), strict=True)))
        return pd.Series(out)

    return df.withColumn("end", run(F.col(value)))


def flux_variability(spark, s: np.ndarray, objective: np.ndarray, low: np.ndarray, high: np.ndarray, names: list[str]) -> DataFrame:
    """reaction, least and greatest: two linear programs a row, spread over tasks."""

    @F.pandas_udf("least double, greatest double")
    def run(index: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([network.flux_variability(s, objective, low, high, int(i)) for i in index], columns=["least", "greatest"])

    rows = spark.createDataFrame(list(enumerate(names)), "i int, reaction string")
    return spread(rows).withColumn("r", run("i")).select("reaction", "r.least", "r.greatest")


def pk_profiles(df: DataFrame, times: list[float]) -> DataFrame:
    """One row a subject and time: t and c of a one-compartment profile from the columns subject, dose, v, cl, ka."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            c = network.simulate_pk_rows(np.array(times), *(batch[k].to_numpy(float, na_value=np.nan) for k in ("dose", "v", "cl", "ka")), step=0.05)
            yield pd.DataFrame({"subject": np.repeat(batch["subject"].to_numpy(), len(times)), "t": np.tile(np.array(times, float), len(batch)), "c": c.ravel()})

    return spread(df.select("subject", "dose", "v", "cl", "ka")).mapInPandas(run, "subject long, t double, c double")


def leader_clusters(df: DataFrame, group: str, seq: str, order: str, identity: float = 0.8) -> DataFrame:
    """order and leader of each sequence: it joins the first leader that it matches well enough, else leads itself."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows, leaders, out = rows.sort_values(order), [], []
        for key, s in zip(rows[order], rows[seq], strict=True):
            found = next((k for k, t in leaders if align_kernel.align(s, t).identity >= identity), None)
            if found is None:
                leaders.append((key, s))
            out.append(key if found is None else found)
        return rows[[group, order]].assign(leader=out)

    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, order)}
    return df.select(group, order, seq).groupBy(group).applyInPandas(one, f"{group} {kinds[group]}, {order} {kinds[order]}, leader {kinds[order]}")


def find_orfs(seq: str, min_aa: int = 30, circular: bool = False, need_stop: bool = False) -> list[tuple[str, int, int, int, bool]]:
    """(strand, start, stop, amino acids, has stop) of open reading frames from every ATG, nested ones too.

    Coordinates are 0-based, half-open, on the top strand, the stop codon included; on a
    circle a frame may run once around, and stop then exceeds the length. Longest first,
    then by start and strand.
    """
    from labspark.functions.sequence import reverse_complement_text, translate_bytes

    n, out = len(seq), []
    for strand, text in (("+", seq), ("-", reverse_complement_text(seq))):
        whole = text + text[: max(0, n - 1)] if circular else text
        for frame in range(3):
            protein = translate_bytes(whole.encode("ascii", "replace"), frame)
            end = len(protein)
            stop_at = None
            for k in range(len(protein) - 1, -1, -1):
                if protein[k] == "*":
                    end, stop_at = k, k
                elif whole[frame + 3 * k : frame + 3 * k + 3] == "ATG":
                    a, b = frame + 3 * k, frame + 3 * (end + (stop_at is not None))
                    if a < n and b - a <= n and end - k >= min_aa and (stop_at is not None or not need_stop):
                        start, stop = (a, b) if strand == "+" else (n - b, n - a)
                        if start < 0:
                            start, stop = start + n, stop + n
                        out.append((strand, start, stop, end - k, stop_at is not None))
    return sorted(out, key=lambda o: (-o[3], o[1], o[0]))


def orfs(df: DataFrame, key: str, seq: str, min_aa: int = 30, circular: bool = False) -> DataFrame:
    """A row for each open reading frame of each sequence; a NULL sequence has none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *o) for k, s in zip(batch[key], batch[seq], strict=True) if s for o in find_orfs(s, min_aa, circular)]
            yield pd.DataFrame(rows, columns=[key, "strand", "start", "stop", "aa", "has_stop"])

    return df.select(key, seq).mapInPandas(run, f"{key} {kind}, strand string, start int, stop int, aa int, has_stop boolean")


def atom_contributions(df: DataFrame, classes: list[dict], column: str = "smiles") -> DataFrame:
    """df with the struct contributions: log_p, refractivity, types by heavy atom, and an error.

    classes is a rule pack's, in order of precedence. The sums are NULL where an atom has no
    class (a NULL among types), as a partial sum is no answer, and for a bad SMILES.
    """
    table = [(c["type"], c["smarts"], c["logP"], c["mr"]) for c in classes]

    @F.pandas_udf("log_p double, refractivity double, types array<string>, error string")
    def sums(texts: pd.Series) -> pd.DataFrame:
        rules, rows = chem.Contributions(table), []
        for text in texts:
            try:
                log_p, mr, types = rules.of(chem.molecule(text or ""))
                rows.append((log_p, mr, types, None if log_p is not None else "an atom has no class"))
            except chem.ChemError as e:
                rows.append((None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["log_p", "refractivity", "types", "error"])

    return spread(df).withColumn("contributions", sums(F.col(column)))


def screen_alerts(df: DataFrame, alerts: list[dict], column: str = "smiles") -> DataFrame:
    """df with alerts: every match of each rule of a pack, by rule, with its meaning, source, severity and atoms.

    A match is a flag of a liability, no verdict. NULL for a bad SMILES, empty without a match.
    """
    fields = ("key", "label", "mechanism", "citation", "severity")

    @F.pandas_udf("array<struct<key: string, label: string, mechanism: string, citation: string, severity: string, atoms: array<int>>>")
    def screen(texts: pd.Series) -> pd.Series:
        rules, out = [({f: a[f] for f in fields}, chem.Pattern(a["smarts"])) for a in alerts], []
        for text in texts:
            try:
                mol = chem.molecule(text or "")
                out.append([told | {"atoms": list(m)} for told, pattern in rules for m in pattern.matches(mol, len(mol.atoms) ** 2 + 1000)])
            except chem.ChemError:
                out.append(None)
        return pd.Series(out)

    return spread(df).withColumn("alerts", screen(F.col(column)))
