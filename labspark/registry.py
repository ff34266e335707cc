"""The tool surface: every operator by name, for dispatch and for SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from labspark.functions import html, sequence, stats
from labspark.kernels import align, chem, fit, formula, network
from labspark.operators import alignment_columns, assay, batch, biologics, catalog_ops, components, design, enrichment, graph, nca, nucleic, pk, protein, similarity, structure
from labspark.sources import rules, sbml, sinks, text_formats

_MODULES = (alignment_columns, assay, batch, biologics, catalog_ops, components, design, enrichment, graph, nca, nucleic, pk, protein, similarity, structure, html, sequence, stats, align, chem, fit, formula, network, rules, sbml, sinks, text_formats)

#: Names under which users know operators of other names here.
ALIASES = {
    "analyze_compound": "smiles_props", "screen_structural_alerts": "screen_alerts", "search_library": "search", "compare_compounds": "tanimoto_top_k", "align_sequences": "align_pairs", "compare_structures": "superpose",
    "fit_dose_response": "fit_curves", "convert_ic50_to_ki": "cheng_prusoff", "simulate_exposure": "pk_profiles", "simulate_population": "population", "noncompartmental_analysis": "nca", "predict_interaction": "auc_ratio",
    "compute_exact_mass": "masses", "balance_equation": "balance", "speciation_at_ph": "species_shares", "solubility_profile": "solubility", "parse_sequence": "sanitize", "translate_sequence": "translate",
    "restriction_map": "find_pattern", "oligo_thermodynamics": "oligo_thermo", "import_assay": "read_plates", "assay_qc": "plate_qc", "fit_binding_kinetics": "langmuir", "fit_enzyme_inhibition": "fit_modality",
    "design_assay": "d_optimal", "biologics_mass": "peptide_mass", "protein_interface": "contacts", "conservation_profile": "conservation", "score_variant": "sift_score", "simulate_reaction_network": "parameter_sweep",
    "fit_stability_kinetics": "arrhenius", "pathway_enrichment": "enrich", "screen_offtarget_panel": "panel_coverage", "check_stack": "interactions", "pharmacogenomic_notes": "banded_notes", "metabolic_flux": "flux_variability",
    "list_runs": "recent_runs", "fetch_structure": "read_pdb", "screen_admet": "hepatic_availability", "run_workflow": "Dag", "antibody_liabilities": "liabilities", "known_metabolites": "metabolites", "dock_compound": "docking_estimate", "web_search": "search_results", "web_fetch": "html_to_text",
}


def operators() -> dict[str, Callable]:
    """Every public function of the operator modules; the first module that has a name keeps it."""
    out: dict[str, Callable] = {}
    for module in _MODULES:
        for name, value in vars(module).items():
            if callable(value) and not name.startswith("_") and getattr(value, "__module__", "") == module.__name__:
                out.setdefault(name, value)
    from labspark.flow import Dag

    out["Dag"] = Dag
    return out


def resolve(name: str) -> Callable:
    """The operator of a name or alias; an unknown name raises KeyError with it."""
    found = operators()
    return found[ALIASES.get(name, name)]


def register_sql(spark: SparkSession) -> list[str]:
    """Scalar kernels as SQL functions, by the names returned."""

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return chem.canonical_smiles(chem.molecule(text or ""))
            except chem.ChemError:
                return None

        return texts.map(one)

    @F.pandas_udf("double")
    def exact_mass(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return formula.masses(*formula.parse_formula(text or ""))[1]
            except chem.ChemError:
                return None

        return texts.map(one).astype("float64")

    @F.pandas_udf("long")
    def alignment_score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([align.align(x or "", y or "").score for x, y in zip(a, b, strict=True)])

    made = {"canonical_smiles": canonical, "exact_mass": exact_mass, "alignment_score": alignment_score}
    for name, f in made.items():
        spark.udf.register(name, f)
    return sorted(made)
