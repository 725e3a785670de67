"""Molecule graphs, and models and distances against plain numpy versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from actiscope.chem import features, graph, standard
from actiscope.operators import distances, models, molecules, similarity
from actiscope.plans import chemistry

SF = "/root/testdata/sf0.001"


def canonical(s):
    return graph.write(graph.parse(s))


@pytest.mark.parametrize("a, b", [
    ("c1ccccc1", "C1=CC=CC=C1"), ("OCC", "CCO"), ("CC(=O)Oc1ccccc1C(=O)O", "OC(=O)C1=CC=CC=C1OC(C)=O"), ("Cn1c(=O)c2c(ncn2C)n(C)c1=O", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C"),
    ("c1ccc2ccccc2c1", "C1=CC=C2C=CC=CC2=C1"), ("O=[N+]([O-])c1ccccc1", "c1ccccc1[N+](=O)[O-]"), ("[Na+].CC([O-])=O", "CC(=O)[O-].[Na+]"), ("c1ccc(-c2ccccc2)cc1", "C1=CC=C(C=C1)C2=CC=CC=C2"), ("C%12CC%12", "C1CC1"), ("C[C@H](N)C(=O)O", "C[C@@H](N)C(=O)O"),
])
def test_spellings_of_one_molecule(a, b):
    assert canonical(a) == canonical(b) == canonical(canonical(a))


def test_every_atom_order_gives_one_text():
    rng = np.random.default_rng(0)
    for s in chemistry.SERIES:
        mol, text = graph.parse(s), canonical(s)
        for _ in range(5):
            p = [int(i) for i in rng.permutation(len(mol))]
            assert graph.write(mol.part(p)) == text


@pytest.mark.parametrize("bad", ["", " ", "CC(", "!!bad!!", "c1ccc", "C(C)(C)(C)(C)C", "C1CC", "=C", "cc", "C==C", "C)", "[Xy", "C11", "(C)"])
def test_no_molecule(bad):
    with pytest.raises(ValueError):
        graph.parse(bad)


def test_known_descriptors():
    for s, mass, tpsa, formula in (("CC(=O)Oc1ccccc1C(=O)O", 180.159, 63.60, "C9H8O4"), ("Cn1c(=O)c2c(ncn2C)n(C)c1=O", 194.194, 61.82, "C8H10N4O2"), ("CC(C)Cc1ccc(C(C)C(=O)O)cc1", 206.285, 37.30, "C13H18O2")):
        m = graph.parse(s)
        d = features.describe(m)
        assert d["mol_weight"] == pytest.approx(mass, abs=5e-3) and d["tpsa"] == pytest.approx(tpsa, abs=5e-3) and features.formula(m) == formula
    assert features.topology(graph.parse("CCCC"))["wiener"] == 10 and features.topology(graph.parse("C1CCCCC1"))["cycles"] == 1


def test_standard_forms_and_scaffolds():
    assert graph.write(standard.standardised(graph.parse("C[N+](C)(C)CC(=O)[O-].[Cl-]"))) == canonical("C[N+](C)(C)CC(=O)O")
    assert standard.deprotected(graph.parse("CC(C)(C)OC(=O)NCc1ccccc1"))[1] == ["Boc"]
    assert graph.write(standard.scaffold(graph.parse("CCOC(=O)c1ccc(Cc2ccncc2)cc1"))) == canonical("c1ccc(Cc2ccncc2)cc1") and standard.scaffold(graph.parse("CCO")) is None
    assert graph.write(standard.scaffold(graph.parse("O=C1CCCCC1C"))) == canonical("O=C1CCCCC1") and len(graph.matches(graph.parse("C(=O)O"), graph.parse("OC(=O)CC(=O)O"))) == 2


@pytest.mark.parametrize("most", [1, 2])
def test_matched_pairs_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(molecules, "MET", 5)  # common constant parts are dealt over several tasks
    rows = [(i, s, float(i % 7) if i % 5 else None) for i, s in enumerate(chemistry.SERIES)]
    d = spark.createDataFrame([*rows, (None, "CCO", 1.0), (90, "!!", 1.0)], "id int, smiles string, y double")
    got = {(r.constant, r.a_id, r.b_id, r.a_variable, r.b_variable, r.delta) for r in molecules.matched_pairs(d, "id", "smiles", "y", most).collect()}
    cut, y = {i: standard.cuts(graph.parse(s), most) for i, s in enumerate(chemistry.SERIES)}, {i: v for i, _, v in rows}
    gap = lambda a, b: None if y[a] is None or y[b] is None else y[b] - y[a]
    want = {(c, a, b, v, w, gap(a, b)) for a, b in itertools.combinations(cut, 2) for c, v in cut[a] for k, w in cut[b] if c == k and v != w}
    assert got == want and len(want) > 100
    t = molecules.transformations(molecules.matched_pairs(d, "id", "smiles", "y", most)).collect()
    assert all(r["from"] < r["to"] and r.n > 0 for r in t)


def cuts_by_parts(mol, most):
    """Cuts by the parts that are left: the part with an end of every bond varies."""
    out = set()
    bonds = [(a, b) for a, b, o in mol.edges() if o == 1 and frozenset((a, b)) not in mol.ring_bonds]
    for k in range(1, most + 1):
        for chosen in itertools.combinations(bonds, k):
            gone = {frozenset(e) for e in chosen}
            parts = graph.Mol(mol.atoms, [{b: o for b, o in n.items() if frozenset((a, b)) not in gone} for a, n in enumerate(mol.bonds)]).components()
            for middle in parts:
                outer = [(next(x for x in e if x not in middle), next((x for x in e if x in middle), None)) for e in chosen]
                if any(m is None for _, m in outer):
                    continue
                texts = {o: standard.capped(mol, next(p for p in parts if o in p), [(o, 0)]) for o, _ in outer}
                if k == 1:
                    out.add((texts[outer[0][0]], standard.capped(mol, middle, [(outer[0][1], 0)])))
                    continue
                ways = [w for w in itertools.permutations(outer) if [texts[o] for o, _ in w] == sorted(texts[o] for o, _ in w)]
                out.add((".".join(sorted(texts[o] for o, _ in outer)), min(standard.capped(mol, middle, [(m, i) for i, (_, m) in enumerate(w, 1)]) for w in ways)))
    return out


@pytest.mark.parametrize("text", ["CCOCC", "COc1ccc(C)cc1", "CC(C)(C)OC(=O)NCc1ccccc1", "CN(C)CCOC(=O)c1ccc(Cl)cc1", "C1CCCCC1"])
def test_cuts_against_parts(text):
    mol = graph.parse(text)
    plain = {c for c in standard.cuts(mol, 3, 99) if c[1] != "[*][H]"}
    assert plain == cuts_by_parts(mol, 3)
    assert all("[*]" in c for c, v in standard.cuts(mol, 1) if v == "[*][H]") and ("[*]c1ccccc1", "[*][H]") in standard.cuts(graph.parse("c1ccccc1"))
    assert ("[*]c1ccccc1", "[*]C") in standard.cuts(graph.parse("Cc1ccccc1"))


def test_standard_forms_of_five_bonds_and_larger_groups_first():
    write = lambda m: graph.write(m)
    for a, b in (("O=N(=O)c1ccccc1", "[O-][N+](=O)c1ccccc1"), ("CN=[N+]=[N-]", "[N-]=[N+]=NC")):
        assert write(standard.standardised(graph.parse(a))) == write(standard.standardised(graph.parse(b)))
    assert standard.deprotected(graph.parse("CC(C)(C)[Si](C)(C)OCC"))[1] == ["TBS"] and standard.deprotected(graph.parse("C[Si](C)(C)OCC"))[1] == ["TMS"]
    assert standard.deprotected(graph.parse("CC(C)[Si](C(C)C)(C(C)C)OCC"))[1] == []


def test_invalid_and_null_structures_are_null(spark):
    d = spark.createDataFrame([(0, None), (1, "bad("), (2, ""), (3, "CCO")], "id int, smiles string")
    r = {x.id: x for x in d.select("id", molecules.canonical("smiles").alias("c"), molecules.fingerprint("smiles").alias("f"), molecules.descriptors("smiles").alias("d"), molecules.counted("smiles", "path").alias("n")).collect()}
    assert all(r[i].c is None and r[i].f is None and r[i].d.mol_weight is None for i in (0, 1, 2)) and r[3].c == "CCO" and len(r[3].f) == 6 and sum(r[3].n.values()) == 3
    with pytest.raises(ValueError):
        molecules.fingerprint("smiles", "nothing")


def test_similarity_at_the_threshold_of_empty_sets_and_of_few_neighbours(spark):
    rows = [(0, list(range(180))), (1, list(range(99))), (2, []), (3, []), (4, [500])]
    f = spark.createDataFrame(rows, "id int, bits array<int>")
    assert {(r.a_id, r.b_id, r.similarity) for r in similarity.similar_pairs(f, 0.55).collect()} == {(0, 1, 0.55), (2, 3, 1.0)}
    near = {(r.query_id, r["rank"]): (r.ref_id, r.similarity) for r in similarity.nearest(f, f, 3).collect()}
    assert len(near) == 15 and near[4, 1] == (0, 0.0) and near[4, 3] == (2, 0.0) and near[2, 1] == (3, 1.0) and near[2, 2] == (0, 0.0)
    m = spark.createDataFrame([([1, 0, 3], [2, 0, 1]), ([0], [0])], "a array<int>, b array<int>").select(similarity.min_max(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in m] == [0.4, 1.0]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 5))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.standard_normal(300)
    return spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i]), float(y[i] > 0)) for i in range(300)] + [(1000, None, 1.0, 1.0), (1001, [float("nan")] * 5, 1.0, 0.0)], "id long, x array<double>, y double, c double"), x, y


def test_distances_in_tiles(spark, table, monkeypatch):
    d, x, _ = table
    monkeypatch.setattr(distances, "ROWS", 70)
    full = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = {r.id: r.distances for r in distances.nearest_distances(d, d, "id", "x", 4, True).collect()}
    np.fill_diagonal(full, np.inf)
    assert set(got) == set(range(300)) and all(got[i] == pytest.approx(np.sort(full[i])[:4], abs=1e-9) for i in got)
    n, s, ss = distances.moments(d, "x")
    assert n == 300 and s == pytest.approx(x.sum(0)) and ss == pytest.approx(x.T @ x)
    mean, axes, values = distances.components(d, "x", 0.9)
    z = (x - x.mean(0)) @ axes
    assert z.var(0) == pytest.approx(values) and abs(np.corrcoef(z.T) - np.eye(z.shape[1])).max() < 1e-6
    inside = {r.id: r.inside for r in distances.component_domain(d.where("id < 200"), d.unionByName(spark.createDataFrame([(2000, [9.0] * 5, 0.0, 0.0)], d.schema)), "id", "x").collect()}
    assert all(inside[i] for i in range(200)) and not inside[2000]
    np.fill_diagonal(full, 0)
    assert tuple(r.id for r in distances.picked(d, "id", "x", 3, "kennard_stone").orderBy("pick").collect())[:2] == np.unravel_index(full.argmax(), full.shape)


def test_models(spark, table, tmp_path):
    d, x, y = table
    pls = models.PartialLeastSquares(d, "x", "y", 5)
    want = np.linalg.lstsq(np.hstack([np.ones((300, 1)), x]), y, rcond=None)[0]
    d2 = d.where("id < 300")
    pls = models.PartialLeastSquares(d2, "x", "y", 5)
    assert pls.coefficients == pytest.approx(want[1:], abs=1e-6)
    shares = models.additive_shares(pls, d2, "id").join(pls.predict(d2, "id"), "id").collect()
    assert all(r.base + sum(r.shares) == pytest.approx(r.prediction) for r in shares)
    weights = models.local_weights(lambda z: z @ np.arange(5.0), np.zeros(5), np.ones(5))
    assert weights == pytest.approx(np.arange(5.0), abs=1e-2)
    forest = models.fitted(d2, "x", "y", "forest", numTrees=8)
    spread = forest.spread(d2, "id").join(forest.predict(d2, "id"), "id").collect()
    assert all(r.mean == pytest.approx(r.prediction) for r in spread) and sum(r.sd for r in spread) > 0
    loss = models.permutation_importance(forest, d2, "id", "y")
    assert max(loss, key=loss.get) == 0 and loss[0] > 5 * abs(loss[4])
    low, high = models.partial_dependence(forest, d2, "id", 0, [-1.5, 1.5])
    assert high[1] > low[1] + 1
    models.saved(forest, str(tmp_path / "bundle"), {"target": "y"})
    again = models.loaded(str(tmp_path / "bundle"))
    assert models.inspected(str(tmp_path / "bundle"))["metadata"] == {"target": "y"}
    assert {r.id: r.prediction for r in again.predict(d2, "id").collect()} == {r.id: r.prediction for r in forest.predict(d2, "id").collect()}
    classes = models.fitted(d2, "x", "c", "logistic", classes=True)
    assert models.scored(classes.predict(d2, "id").join(d2.select("id", "c"), "id"), "c", ["accuracy", "mcc"])["accuracy"] > 0.9
    with pytest.raises(ValueError):
        models.fitted(d2, "x", "y", "nothing")
    with pytest.raises(ValueError):
        models.scored(d2, "y", ["nothing"])


def test_search(spark, table):
    d = table[0].where("id < 300")
    best, tried = models.searched(d, "id", "x", "y", {"maxDepth": [1, 4]}, "tree", folds=2)
    assert best == {"maxDepth": 4} and len(tried) == 2
    out = models.nested(d, "id", "x", "y", {"maxDepth": [1, 4]}, "tree", outer=2, inner=2)
    assert [r["fold"] for r in out] == [0, 1] and all(r["r2"] > 0.3 for r in out)
