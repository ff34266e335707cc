import math
import random

import numpy as np
import pytest

from labspark.kernels import align, chem, fit, formula, network, special


def test_dose_response_and_refusals():
    c = 10.0 ** np.linspace(-9, -5, 12)
    y = fit.logistic4(np.log10(c), np.array([100, 1.2, -7, 5.0]))
    got = fit.fit_4pl(c, y)
    assert np.allclose(got.params, [100, 1.2, -7, 5], rtol=1e-6) and got.errors is not None
    assert fit.fit_4pl(c[:3], y[:3]).refusal and fit.fit_4pl(-c, y).refusal and fit.fit_5pl(c[:5], y[:5]).refusal
    five = fit.fit_5pl(c, fit.logistic5(np.log10(c), np.array([90, 1.0, -7, 2, 0.7])))
    assert fit.ec50_5pl(five.params) == pytest.approx(1e-7 * (2 ** (1 / 0.7) - 1) ** -1.0, rel=1e-3)
    x, _ = fit.inverse_predict(got, 52.5)
    assert x == pytest.approx(1e-7, rel=1e-6) and fit.inverse_predict(got, 200) is None
    low, high = fit.profile_interval(fit.logistic4, np.log10(c), y + np.random.default_rng(1).normal(0, 1, 12), fit.fit_4pl(c, y + np.random.default_rng(1).normal(0, 1, 12)), 2)
    assert low < -7 < high


def test_rank_deficient_fit_has_no_errors():
    x = np.linspace(0, 1, 9)
    got = fit.levenberg_marquardt(lambda t, p: (p[0] + p[1]) * t, x, 3 * x, np.array([1.0, 1.0]))
    assert got.errors is None and got.refusal and got.params.sum() == pytest.approx(3)


def test_outlier_has_little_weight():
    x = np.linspace(1, 10, 20)
    y = 2 * x + 1
    y[5] += 100
    assert np.allclose(fit.robust(lambda t, p: p[0] * t + p[1], x, y, np.array([1.0, 0.0])).params, [2, 1], atol=1e-6)


@pytest.mark.parametrize("mode", list(fit.MODALITIES))
def test_inhibition_modes(mode):
    s, i = (a.ravel() for a in np.meshgrid([0.5, 1, 2, 4, 8, 16, 32.0], [0, 1, 4.0]))
    assert fit.fit_modality(s, i, fit.MODALITIES[mode](s, i, np.array([10, 3, 2, 5.0])))[0] == mode


def test_biophysics():
    t = np.linspace(280, 320, 6)
    assert fit.arrhenius(t, np.exp(25 - 60 / (8.314462618e-3 * t))).params == pytest.approx([25, 60], rel=1e-5)
    assert fit.eyring(t, 1.380649e-23 * t / 6.62607015e-34 * np.exp(-70e3 / 8.314462618 / t + 20 / 8.314462618)).params == pytest.approx([70, 20], rel=1e-4)
    x = np.linspace(30, 80, 60)
    assert fit.two_state_melt(x, 1 + 4 / (1 + np.exp((55 - x) / 2))).params[2] == pytest.approx(55, abs=1e-4)
    tt, cc = np.tile(np.linspace(0, 300, 40), 3), np.repeat([1e-8, 5e-8, 2e-7], 40)
    rate = 1e5 * cc + 1e-3
    r = 80 * 1e5 * cc / rate * -np.expm1(-rate * np.minimum(tt, 150)) * np.exp(-1e-3 * np.maximum(tt - 150, 0))
    assert fit.langmuir(tt, r, cc, 150).params == pytest.approx([5, -3, 80], rel=1e-3)
    assert all(f.refusal for f in (fit.arrhenius(t[:2], t[:2]), fit.two_state_melt(x[:3], x[:3]), fit.langmuir(tt[:40], r[:40], cc[:40], 1), fit.wiseman(x[:3], x[:3], 1e-5, 0.1)))


def brute_alignment(a, b, local):
    low = -(10**9)
    h, x, y = ([[low] * (len(b) + 1) for _ in range(len(a) + 1)] for _ in range(3))
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i:
                x[i][j] = max(h[i - 1][j] - 12, x[i - 1][j] - 1)
            if j:
                y[i][j] = max(h[i][j - 1] - 12, y[i][j - 1] - 1)
            best = max(x[i][j], y[i][j], 0 if local or i == j == 0 else low)
            if i and j:
                best = max(best, h[i - 1][j - 1] + int(align.MATRIX[align.AMINO.find(a[i - 1]), align.AMINO.find(b[j - 1])]))
            h[i][j] = best
    return max(map(max, h)) if local else h[-1][-1]


@pytest.mark.parametrize("local", [False, True])
def test_alignment_by_full_table(local):
    rng = random.Random(3)
    for _ in range(60):
        a = "".join(rng.choice(align.AMINO) for _ in range(rng.randint(0, 20)))
        b = a[3:] + "".join(rng.choice(align.AMINO) for _ in range(rng.randint(0, 8)))
        got = align.align(a, b, local)
        assert got.score == brute_alignment(a, b, local) and len(got.a) == len(got.b)
    assert (align.MATRIX == align.MATRIX.T).all()


def test_special_functions():
    assert special.chi2_survival(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12) and special.chi2_survival(18.307, 10) == pytest.approx(0.05, abs=1e-5)
    assert special.normal_quantile([0.025, 0.975, 1e-10]) == pytest.approx([-1.959963984540054, 1.959963984540054, -6.361340902404056], rel=1e-12)
    rng = np.random.default_rng(1)
    x = special.iman_conover(rng.random((4000, 2)), np.array([[1, 0.7], [0.7, 1]]), rng)
    assert special.spearman(x[:, 0], x[:, 1]) == pytest.approx(0.7, abs=0.03) and special.cholesky([[1, 2], [2, 1]]) is None
    h = special.latin_hypercube(50, 3, rng)
    assert all(sorted((h[:, j] * 50).astype(int)) == list(range(50)) for j in range(3))


def test_solvers():
    net = network.Network({"A": 10.0, "B": 0.0}, [network.Reaction("r", {"A": 1}, {"B": 1}, "mass_action", {"k": 0.5})])
    assert network.stiff(net.rhs, net.jacobian, net.start, 0, 4, 1e-8)[1][-1, 0] == pytest.approx(10 * math.exp(-2), rel=1e-7)
    t, y = network.rk4(net.rhs, net.start, 0, 0.35, 0.1)
    assert t[-1] == 0.35 and y[-1, 0] == pytest.approx(10 * math.exp(-0.175), rel=1e-7)
    rng = np.random.default_rng(2)
    mean = np.mean([net.gillespie(1, rng)[1][-1][0] for _ in range(400)])
    assert mean == pytest.approx(10 * math.exp(-0.5), abs=0.4)
    big = network.Network({"A": 5000.0, "B": 0.0}, net.reactions)
    assert np.mean([big.tau_leap(1, rng)[0] for _ in range(20)]) == pytest.approx(5000 * math.exp(-0.5), rel=0.03)
    with pytest.raises(ValueError):
        network.Network({"A": 1.0}, [network.Reaction("r", {"A": 1}, {}, "michaelis_menten", {"vmax": 1, "km": 1})]).gillespie(1, rng)
    with pytest.raises(ValueError):
        network.Network({"A": 1.0}, [network.Reaction("r", {"Z": 1}, {})])
    stiff3 = network.Network({"a": 1.0, "b": 0.0, "c": 0.0}, [network.Reaction("1", {"a": 1}, {"b": 1}, "mass_action", {"k": 0.04}), network.Reaction("2", {"b": 2}, {"b": 1, "c": 1}, "mass_action", {"k": 3e7}), network.Reaction("3", {"b": 1, "c": 1}, {"a": 1, "c": 1}, "mass_action", {"k": 1e4})])
    end = network.stiff(stiff3.rhs, stiff3.jacobian, stiff3.start, 0, 40)[1][-1]
    assert end == pytest.approx([0.7158271, 9.1855e-6, 0.2841637], rel=1e-4) and end.sum() == pytest.approx(1, abs=1e-12)


def test_dosing():
    t = np.array([0, 1, 5.0])
    assert network.simulate_pk(t, [network.Dose(0, 100)], 50, 5) == pytest.approx(2 * np.exp(-0.1 * t), rel=1e-8)
    oral = network.simulate_pk(t, [network.Dose(0, 100)], 50, 5, ka=1.0)
    assert oral == pytest.approx(100 / (50 * 0.9) * (np.exp(-0.1 * t) - np.exp(-t)), rel=1e-6)
    steady = network.simulate_pk(np.array([200.0]), [network.Dose(0, 1000, 400.0)], 50, 5, step=0.1)
    assert steady[0] == pytest.approx(2.5 / 5, rel=1e-6)


def test_linear_programs():
    s, c = np.array([[1, -1, -1, 0], [0, 1, 0, -1], [0, 0, 1, -1.0]]), np.array([0, 0, 0, 1.0])
    low, high = np.zeros(4), np.array([10, 8, 8, 100.0])
    assert network.flux_balance(s, c, low, high)[1] == pytest.approx([10, 5, 5, 5])
    assert network.deletion(s, c, low, high, (1,)) == 0 and network.flux_variability(s, c, low, high, 1) == pytest.approx((5, 5))
    assert network.linear_program(np.array([1.0]), np.zeros((1, 1)), np.array([1.0]), np.zeros(1), np.ones(1))[0] == "infeasible"
    assert network.linear_program(np.array([1.0]), np.zeros((0, 1)), np.zeros(0), np.zeros(1), np.array([np.inf]))[0] == "unbounded"
    rng = np.random.default_rng(4)
    for _ in range(40):  # against all vertices
        a, b, cost = rng.integers(-3, 4, (2, 4)).astype(float), None, rng.integers(-3, 4, 4).astype(float)
        b = a @ rng.random(4) * 2
        status, x = network.linear_program(cost, a, b, np.zeros(4), np.full(4, 2.0))
        assert status == "optimal" and np.allclose(a @ x, b, atol=1e-7) and (x > -1e-7).all() and (x < 2 + 1e-7).all()
        best = -np.inf
        for code in range(3**4):
            at = [(code // 3**k) % 3 for k in range(4)]
            free = [k for k in range(4) if at[k] == 2]
            if len(free) > 2:
                continue
            z = np.array([0.0 if v == 0 else 2.0 for v in at])
            if free:
                z[free] = 0
                z[free] = np.linalg.lstsq(a[:, free], b - a @ z, rcond=None)[0]
            if np.allclose(a @ z, b, atol=1e-7) and (z > -1e-7).all() and (z < 2 + 1e-7).all():
                best = max(best, cost @ z)
        assert cost @ x == pytest.approx(best, abs=1e-6)


MOLECULES = {
    "CC(=O)Oc1ccccc1C(=O)O": ("C9H8O4", 180.159, 63.60), "CN1C=NC2=C1C(=O)N(C(=O)N2C)C": ("C8H10N4O2", 194.194, 60.26), "CC(C)Cc1ccc(cc1)C(C)C(=O)O": ("C13H18O2", 206.285, 37.30),
    "c1ccc2ccccc2c1": ("C10H8", 128.174, 0.0), "c1cc[nH]c1": ("C4H5N", 67.091, 15.79), "c1ccncc1": ("C5H5N", 79.102, 12.89), "CC#N": ("C2H3N", 41.053, 23.79), "OCC(O)C(O)C(O)C(O)C=O": ("C6H12O6", 180.156, 118.22),
}


@pytest.mark.parametrize("smiles", MOLECULES)
def test_molecules(smiles):
    mol = chem.molecule(smiles)
    d = chem.descriptors(mol)
    want = MOLECULES[smiles]
    assert (d["formula"], round(d["mol_weight"], 2), round(d["tpsa"], 2)) == (want[0], round(want[1], 2), want[2])
    text = chem.canonical_smiles(mol)
    rng, n = random.Random(1), len(mol.atoms)
    for _ in range(10):
        order = list(range(n))
        rng.shuffle(order)
        other = chem.Molecule()
        for i in order:
            a = mol.atoms[i]
            other.add(chem.Atom(a.symbol, a.aromatic, a.charge, a.hydrogens, implicit=a.implicit))
        for b in rng.sample(mol.bonds, len(mol.bonds)):
            other.join(order.index(b.a), order.index(b.b), b.order, b.aromatic)
        chem.perceive(other)
        assert chem.canonical_smiles(other) == text and chem.fingerprint(other) == chem.fingerprint(mol)


def test_spellings_patterns_and_refusals():
    same = lambda a, b: chem.canonical_smiles(chem.molecule(a)) == chem.canonical_smiles(chem.molecule(b))
    assert same("CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "Cn1cnc2c1c(=O)n(C)c(=O)n2C") and same("C1=CC=CC=C1C", "Cc1ccccc1") and not same("CCO", "COC")
    hits = lambda p, s: len(chem.Pattern(p).matches(chem.molecule(s)))
    assert hits("c1ccccc1", "c1ccccc1") == 1 and hits("c1ccccc1", "c1ccc2ccccc2c1") == 2
    assert hits("[CX3](=O)[OX2H1]", "CC(C)Cc1ccc(cc1)C(C)C(=O)O") == 1 and hits("[$([CX3](=O)[OX2H1])]", "CC(=O)O") == 1 and hits("[NX3;!$(NC=O)]", "CC(=O)N") == 0
    for bad in ("C(", "C1CC", "X", "[Qq]", "C))", "", "C=", "CC%1"):
        with pytest.raises(chem.ChemError):
            chem.parse_smiles(bad)
    for bad in ("[C;$(C]", "[C", "C[@TH1]", "C$C"):
        with pytest.raises(chem.ChemError):
            chem.Pattern(bad)
    assert chem.fnv1a("") == 0xCBF29CE484222325 and chem.fnv1a("a") == 0xAF63DC4C8601EC8C


def test_formulas():
    assert formula.parse_formula("Ca(OH)2")[0] == {"Ca": 1, "O": 2, "H": 2} and formula.parse_formula("CuSO4"[2:] + "·5H2O")[0]["H"] == 10 and formula.parse_formula("NH4+")[1] == 1
    counts, _ = formula.parse_formula("C6H12O6")
    assert formula.masses(counts)[1] == pytest.approx(180.0633881, abs=1e-5) and formula.hill(counts) == "C6H12O6" and formula.unsaturation(counts) == 1
    peaks = formula.envelope(formula.parse_formula("C10Br")[0])
    assert peaks[2][1] / peaks[0][1] == pytest.approx(0.4931 / 0.5069 + 45 * (0.0107 / 0.9893) ** 2, rel=1e-6)
    assert formula.find_formulas(180.0633881, 2, {"C": 10, "H": 24, "O": 8, "N": 0})[0][0] == "C6H12O6"
    assert formula.balance(["C3H8", "O2"], ["CO2", "H2O"]) == [1, 5, 3, 4] and formula.balance(["MnO4-", "H+", "Fe+2"], ["FeO"]) is None and formula.balance(["H2"], ["O2"]) is None
    assert formula.solution_ph(0.1, [4.76], 0) == pytest.approx(2.88, abs=0.01) and formula.mean_charge(4.76, [4.76], 0) == pytest.approx(-0.5)
    assert formula.log_d(7.4, 3.0, [4.4], 0) == pytest.approx(3 - math.log10(1 + 10**3), abs=1e-9)


def spelled(edges, n, rng):
    """A SMILES of a carbon skeleton written in a random order, with all ring bonds as closures."""
    order = list(range(n))
    rng.shuffle(order)
    near = {i: [] for i in range(n)}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    for i in near:
        rng.shuffle(near[i])
    label, seen, used = {}, set(), set()

    def walk(v, parent):
        seen.add(v)
        text, branches = "C", []
        for m in near[v]:
            key = frozenset((v, m))
            if m == parent or key in used:
                continue
            if m in seen:
                used.add(key)
                label[key] = len(label) + 1
                closures[v].append(label[key])
                closures[m].append(label[key])
            else:
                used.add(key)
                branches.append(walk(m, v))
        tree[v] = branches
        return v

    closures, tree = {i: [] for i in range(n)}, {}
    start = walk(order[0], None)

    def write(v):
        own = "C" + "".join(f"%{c:02d}" for c in closures[v])
        parts = [write(b) for b in tree[v]]
        return own + "".join(f"({p})" for p in parts[:-1]) + (parts[-1] if parts else "")

    return write(start)


def test_canonical_form_of_symmetric_cages():
    import random

    rng = random.Random(2)
    cages = {
        "cube": ([(a, a ^ b) for a in range(8) for b in (1, 2, 4) if a < a ^ b], 8),
        "petersen": ([(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)], 10),
        "prism": ([(i, (i + 1) % 7) for i in range(7)] + [(7 + i, 7 + (i + 1) % 7) for i in range(7)] + [(i, i + 7) for i in range(7)], 14),
        "dodecahedron": ([(i, (i + 1) % 10) for i in range(10)] + [(i, 10 + i) for i in range(10)] + [(10 + i, 10 + (i + 2) % 10) for i in range(10)], 20),
    }
    for trial in range(12):  # random cubic skeletons
        while True:
            ends = [i for i in range(14) for _ in range(3)]
            rng.shuffle(ends)
            edges = {frozenset(e) for e in zip(ends[::2], ends[1::2], strict=True)}
            if len(edges) == 21 and all(len(e) == 2 for e in edges):
                seen, todo = {0}, [0]
                while todo:
                    v = todo.pop()
                    for e in edges:
                        if v in e and (m := next(iter(e - {v}))) not in seen:
                            seen.add(m)
                            todo.append(m)
                if len(seen) == 14:
                    break
        cages[f"random {trial}"] = ([tuple(e) for e in edges], 14)
    for name, (edges, n) in cages.items():
        forms = {chem.canonical_smiles(chem.molecule(spelled(edges, n, rng))) for _ in range(8)}
        assert len(forms) == 1, (name, forms)


def test_canonical_form_of_many_equal_branches():
    phenyl = "c1ccccc1"
    text = chem.canonical_smiles(chem.molecule("C(" + ")(".join([phenyl] * 3) + ")C(" + phenyl + ")(" + phenyl + ")" + phenyl))
    assert text == chem.canonical_smiles(chem.molecule(text))
    butyls = "CC(C)(C)C1=CC(C(C)(C)C)=CC(C(C)(C)C)=C1"
    assert chem.canonical_smiles(chem.molecule(butyls)) == chem.canonical_smiles(chem.molecule("c1(C(C)(C)C)cc(C(C)(C)C)cc(C(C)(C)C)c1"))
