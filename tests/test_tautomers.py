"""Tautomers of one compound have one canonical form; what has no shifts keeps its own."""

import pytest

from actiscope.chem import graph, tautomer
from actiscope.operators import tautomers

PAIRS = [
    ("Oc1ccccn1", "O=c1cccc[nH]1"), ("Oc1ccncc1", "O=c1cc[nH]cc1"), ("CC(=O)CC(C)=O", "CC(O)=CC(C)=O"), ("CC(N)=O", "CC(O)=N"), ("Cc1cnc[nH]1", "Cc1c[nH]cn1"), ("CC(=N)N(C)C", "C=C(N)N(C)C"), ("OC1=CCCCC1", "O=C1CCCCC1"),
    ("Nc1nc2[nH]cnc2c(=O)[nH]1", "Nc1nc2nc[nH]c2c(O)n1"), ("Sc1ccccn1", "S=c1cccc[nH]1"), ("c1ccc2[nH]ncc2c1", "c1ccc2n[nH]cc2c1"),
]
ALONE = ["Oc1ccccc1", "c1ccccc1", "CCO", "CCN(C)C", "C[N+](C)(C)C", "O=C(O)c1ccccc1"]


def test_pairs_and_single_forms(spark):
    rows = [(i, j, s) for i, pair in enumerate(PAIRS) for j, s in enumerate(pair)] + [(100 + i, 0, s) for i, s in enumerate(ALONE)] + [(200, 0, "!!"), (201, 0, None), (300, 0, "CC(N)=O"), (301, 1, "CC(N)=O")]
    d = spark.createDataFrame(rows, "id int, side int, smiles string").coalesce(2)
    got = {(r.id, r.side): r.tautomer for r in tautomers.canonicalised(d, "smiles").collect()}
    assert len(got) == len(rows)
    for i, pair in enumerate(PAIRS):
        assert got[i, 0] == got[i, 1] and got[i, 0] is not None, pair
    write = lambda s: graph.write(graph.parse(s))
    assert got[0, 0] == write("O=c1cccc[nH]1") and got[2, 0] == write("CC(=O)CC(C)=O") and got[3, 0] == got[300, 0] == got[301, 1] == write("CC(N)=O") and got[6, 0] == write("O=C1CCCCC1")
    assert [got[100 + i, 0] for i in range(len(ALONE))] == [write(s) for s in ALONE]
    assert got[200, 0] is None and got[201, 0] is None
    assert tautomers.canonicalised(d.where("false"), "smiles").count() == 0


@pytest.mark.parametrize("text", [s for pair in PAIRS for s in pair])
def test_shifts_keep_the_formula_and_go_back(text):
    from actiscope.chem.features import formula

    mol = graph.parse(text)
    for new in tautomer.shifts(mol):
        assert formula(new) == formula(mol) and graph.write(new) != graph.write(mol)
        assert graph.write(mol) in {graph.write(m) for m in tautomer.shifts(new)}
