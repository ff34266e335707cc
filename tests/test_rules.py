"""Rule packs, sums over atom classes and alerts, against published contributions and hand counts."""

import json

import pytest

from labspark.kernels import chem
from labspark.operators.batch import atom_contributions, screen_alerts
from labspark.sources.rules import read_rules

# A few published atom classes (logP, molar refractivity), enough for the molecules below.
CLASSES = [("C1", "[CH3]C", 0.1441, 2.503), ("C3", "[CH2X4][N,O,P,S,F,Cl,Br,I]", -0.2035, 2.753), ("C5", "[C]=[A;!#1;!#6]", -0.2783, 5.007), ("C18", "[cH]", 0.1581, 3.350), ("O9", "[O]=[#6]", -0.1188, 0.2215), ("O2", "[OH,OH2]", -0.2893, 0.8238)]


@pytest.fixture
def pack(tmp_path):
    def write(**content):
        (tmp_path / "pack.json").write_text(json.dumps({"schemaVersion": 1} | content))
        return str(tmp_path / "pack.json")

    return write


def test_sums_over_atom_classes(spark, pack):
    path = pack(classes=[dict(zip(("type", "smarts", "logP", "mr"), c, strict=True)) for c in CLASSES])
    classes, errors = read_rules(spark, path, "classes")
    assert errors == [] and [c["type"] for c in classes] == [c[0] for c in CLASSES]
    smiles = ["c1ccccc1", "C1=CC=CC=C1", "CCO", "CC(=O)O", "CCF", "C(", None]
    rows = atom_contributions(spark.createDataFrame([(i, s) for i, s in enumerate(smiles)], "id int, smiles string"), classes).collect()
    got = {r.id: r.contributions for r in rows}
    assert got[0].log_p == pytest.approx(6 * 0.1581 + 6 * 0.1230) and got[0].refractivity == pytest.approx(6 * 3.350 + 6 * 1.057)
    assert got[1].log_p == pytest.approx(got[0].log_p, abs=1e-12)
    assert got[2].types == ["C1", "C3", "O2"] and got[2].log_p == pytest.approx(0.1441 - 0.2035 - 0.2893 + 5 * 0.1230 - 0.2677)
    assert got[3].types == ["C1", "C5", "O9", "O2"] and got[3].log_p == pytest.approx(0.1441 - 0.2783 - 0.1188 - 0.2893 + 3 * 0.1230 + 0.2980)
    assert got[4].log_p is None and got[4].types == ["C1", "C3", None] and "class" in got[4].error
    assert got[5].log_p is None and got[5].error and got[6].types in ([], None)


@pytest.mark.parametrize(("smiles", "kinds"), [("O", ["H2"]), ("CO", ["H1", "H2"]), ("Oc1ccccc1", ["H2"] + [None] + ["H1"] * 5), ("OC=O", ["H4", "H1", None]), ("ON", ["H3", "H3"]), ("OO", ["H4", "H4"]), ("CS", ["H1", "H2"]), ("OC(=O)N", ["H4", None, None, "H3"])])
def test_hydrogens_by_what_bears_them(smiles, kinds):
    mol = chem.molecule(smiles)
    rules = chem.Contributions([])
    assert [next((k for k, p in rules.hydrogens if p.matches(mol, 1, i)), None) if a.h else None for i, a in enumerate(mol.atoms)] == kinds


def test_alerts_carry_their_meaning(spark, pack):
    told = {"label": "aniline", "mechanism": "oxidised", "citation": "a paper", "severity": "warn"}
    alerts = [{"key": "aniline", "smarts": "[NX3;H2]c"} | told, {"key": "epoxide", "smarts": "C1OC1"} | told | {"severity": "info"}]
    faulty = [{"key": "x", "smarts": "C("} | told, {"key": "y", "smarts": "C"} | told | {"severity": "danger"}, {"key": "z", "smarts": "C"}, "none"]
    rules, errors = read_rules(spark, pack(alerts=alerts + faulty), "alerts")
    assert [r["key"] for r in rules] == ["aniline", "epoxide"] and [f"rule {n} " in e for n, e in zip((3, 4, 5, 6), errors, strict=True)] == [True] * 4
    df = spark.createDataFrame([(1, "Nc1ccc(N)cc1"), (2, "C1OC1C"), (3, "CC"), (4, "C1")], "id int, smiles string")
    got = {r.id: r.alerts for r in screen_alerts(df, rules).collect()}
    assert [(a.key, a.severity, a.citation) for a in got[1]] == [("aniline", "warn", "a paper")] * 2 and {tuple(a.atoms)[0] for a in got[1]} == {0, 5}
    assert [(a.key, a.severity) for a in got[2]] == [("epoxide", "info")] and got[3] == [] and got[4] is None


def test_packs_that_are_none(spark, pack, tmp_path):
    assert read_rules(spark, pack(schemaVersion=2, groups=[]), "groups")[1][0].endswith("schemaVersion must be 1")
    assert read_rules(spark, pack(groups=1), "groups")[1][0].endswith("there is no array groups")
    (tmp_path / "text.json").write_text("not JSON")
    assert read_rules(spark, str(tmp_path / "text.json"), "groups")[0] == []
