import json

import numpy as np
import pytest

from labspark.kernels.network import Network, Reaction
from labspark.sources import text_formats as tf
from labspark.sources.sbml import read_sbml, write_sbml


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">sp|P1|X first protein OS=Homo sapiens OX=9606\nMKV\nLA 1\n>two\nACDE" + "F" * 130 + "\n")
    got = {r.id: r for r in tf.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got["sp|P1|X"].seq == "MKVLA" and got["sp|P1|X"].dropped == 1 and got["sp|P1|X"].organism == "Homo sapiens" and got["sp|P1|X"].accession == "P1"
    tf.write_fasta(tf.read_fasta(spark, str(tmp_path / "a.fasta")), str(tmp_path / "out"))
    lines = [x for f in (tmp_path / "out").glob("part-*") for x in f.read_text().split("\n")]
    assert max(len(x) for x in lines if not x.startswith(">")) == 60
    again = {r.id: r.seq for r in tf.read_fasta(spark, str(tmp_path / "out")).collect()}
    assert again == {k: v.seq for k, v in got.items()}


def test_gmt(spark, tmp_path):
    (tmp_path / "s.gmt").write_text("# release: 1\nR-1\tA pathway\tTP53\tMDM2\tTP53\nAnother pathway\tR-2\tX\t\n")
    got = sorted((r.id, r.title, r.member) for r in tf.read_gmt(spark, str(tmp_path / "s.gmt")).collect())
    assert got == [("R-1", "A pathway", "MDM2"), ("R-1", "A pathway", "TP53"), ("R-2", "Another pathway", "X")]


PDB = """HEADER    TEST
MODEL        1
ATOM      1  N   ALA A   1A     11.104   6.134  -6.504  1.00 20.00           N
HETATM    2  O   HOH B 201       1.000   2.000   3.000  0.50 10.00           O
ENDMDL
MODEL        2
ATOM      3  CA  GLY A   2      12.000   7.000  -5.000  1.00 21.00           C
ENDMDL
"""
CIF = """data_X
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.auth_atom_id
_atom_site.label_alt_id
_atom_site.auth_comp_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.pdbx_PDB_ins_code
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.B_iso_or_equiv
_atom_site.pdbx_PDB_model_num
ATOM 1 N N . ALA A 1 A 11.104 6.134 -6.504 1.00 20.00 1
HETATM 2 O O . HOH B 201 ? 1.000 2.000 3.000 0.50 10.00 1
ATOM 3 C "CA" . GLY A 2 ? 12.000 7.000 -5.000 1.00 21.00 2
loop_
_other.a
1
"""


def test_pdb_and_cif_agree(spark, tmp_path):
    (tmp_path / "a.pdb").write_text(PDB)
    (tmp_path / "a.cif").write_text(CIF)
    rows = lambda df: sorted(tuple(r[1:]) for r in df.collect())
    pdb, cif = rows(tf.read_pdb(spark, str(tmp_path / "a.pdb"))), rows(tf.read_cif(spark, str(tmp_path / "a.cif")))
    assert pdb == cif and len(pdb) == 3
    assert pdb[0] == (1, 1, "N", "", "ALA", "A", 1, "A", 11.104, 6.134, -6.504, 1.0, 20.0, "N", False) and pdb[2][0] == 2


GB = """LOCUS       TEST1                 20 bp    DNA     circular SYN 01-JAN-2000
DEFINITION  A test
            record.
FEATURES             Location/Qualifiers
     CDS             complement(join(1..6,
                     9..11))
                     /gene="abc"
                     /note="two
                     words"
     misc            <3..>8
     bad             one-of(1,2)
ORIGIN
        1 acgtacgtac gtacgtacgt
//
LOCUS       TEST2                 4 bp    DNA     linear
ORIGIN
        1 aaaa
//
"""


def test_genbank(spark, tmp_path):
    (tmp_path / "a.gb").write_text(GB)
    got = {r.locus: r for r in tf.read_genbank(spark, str(tmp_path / "a.gb")).collect()}
    one = got["TEST1"]
    assert one.circular and one.length == 20 and one.seq == "ACGT" * 5 and one.definition == "A test record." and not got["TEST2"].circular
    cds = one.features[0]
    assert [tuple(p) for p in cds.parts] == [(8, 11, True), (0, 6, True)] and cds.qualifiers == {"gene": "abc", "note": "two words"}
    assert [tuple(p) for p in one.features[1].parts] == [(2, 8, False)] and len(one.warnings) == 1


def test_plates(spark, tmp_path):
    (tmp_path / "long.csv").write_text("Plate_ID,Well,ROLE,Concentration,readout,Operator\nP1,A1,max,1e-6,100,Ann\nP1,AF12,dmso,,x,Ben\nP1,h2,compound,oops,5,\n")
    got = {r.well: r for r in tf.read_plates(spark, str(tmp_path / "long.csv")).collect()}
    assert (got["A1"].row, got["A1"].col, got["A1"].role, got["A1"].conc, got["A1"].metadata) == (0, 0, "positive", 1e-6, {"operator": "Ann"})
    assert (got["AF12"].row, got["AF12"].value, got["AF12"].excluded, len(got["AF12"].warnings)) == (31, None, True, 1)
    assert got["h2"].conc is None and got["h2"].warnings == ["concentration 'oops' is no number"]
    (tmp_path / "grid.csv").write_text("," + ",".join(map(str, range(1, 13))) + "\n" + "\n".join(f"{r}," + ",".join(str(i) for i in range(12)) for r in "ABCDEFGH") + "\n\n")
    grid = tf.read_plates(spark, str(tmp_path / "grid.csv")).collect()
    assert len(grid) == 96 and max(r.row for r in grid) == 7 and all(r.value == r.col for r in grid)
    assert tf.parse_plate("\n \n") == [] and tf.well_position("A0") is None


def test_packs(spark, tmp_path):
    good = {"schemaVersion": 1, "id": "a", "title": "A", "compounds": [{"id": "x", "name": "X", "smiles": "CC"}], "targets": []}
    files = {"good": good, "version": good | {"schemaVersion": 2}, "twice": good | {"compounds": good["compounds"] * 2}, "untitled": good | {"title": ""}, "box": good | {"targets": [{"id": "t", "name": "T", "box": {"sx": 1, "sy": 1, "sz": 0}}]}}
    for name, pack in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(pack))
    (tmp_path / "broken.json").write_text("{")
    packs, errors = tf.read_packs(spark, str(tmp_path / "*.json"))
    assert [r.id for r in packs.collect()] == ["a"]
    assert {r.file.rsplit("/", 1)[1]: r.error for r in errors.collect()} == {
        "version.json": "schemaVersion must be 1", "twice.json": "a compound id occurs twice", "untitled.json": "title is missing", "box.json": "a box needs a structure and positive edges", "broken.json": "no readable pack",
    }


def test_sbml_round_trip_and_refusal():
    net = Network({"A": 2.0, "B": 0.5, "X": 1.0}, [Reaction("r1", {"A": 2}, {"B": 1}, "mass_action", {"k": 0.3}), Reaction("r2", {"A": 1}, {"B": 1}, "reversible", {"k": 1.0, "k_back": 2.0}), Reaction("r3", {"B": 1}, {"X": 1}, "michaelis_menten", {"vmax": 3.0, "km": 0.4}), Reaction("r4", {}, {"A": 1}, "constant", {"k": 0.1})], frozenset({"X"}))
    text = write_sbml(net)
    back = read_sbml(text)
    assert back.names == net.names and back.boundary == net.boundary and [r.law for r in back.reactions] == [r.law for r in net.reactions]
    assert np.allclose(back.rhs(0, net.start), net.rhs(0, net.start))
    with pytest.raises(ValueError, match="listOfEvents"):
        read_sbml(text.replace("<listOfReactions>", "<listOfEvents><event/></listOfEvents><listOfReactions>"))
    with pytest.raises(ValueError, match="r1"):
        read_sbml(text.replace("<times/><ci>r1_k</ci>", "<times/><ci>r1_k</ci><ci>B</ci>"))


def test_formats_told_by_first_line_and_extension(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n  \n>x some\nACGTN\n")
    (tmp_path / "b.txt").write_text("\n" + GB)
    (tmp_path / "c.txt").write_text("neither\n")
    (tmp_path / "d.txt").write_text("")
    assert [(r.id, r.seq) for r in tf.read_nucleic(spark, str(tmp_path / "a.txt")).collect()] == [("x", "ACGTN")]
    assert {r.locus for r in tf.read_nucleic(spark, str(tmp_path / "b.txt")).collect()} == {"TEST1", "TEST2"}
    for name in ("c.txt", "d.txt"):
        with pytest.raises(ValueError, match="neither FASTA"):
            tf.read_nucleic(spark, str(tmp_path / name))
    for name, text in (("a.PDB", PDB), ("a.ent", PDB), ("a.cif", CIF), ("a.mmCIF", CIF)):
        (tmp_path / name).write_text(text)
        assert tf.read_structure(spark, str(tmp_path / name)).count() == 3
    assert tf.read_structure(spark, str(tmp_path / "a.txt")) is None
