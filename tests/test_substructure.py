"""Patterns as expressions: known molecules, a plain search over all placements, defined cases."""

import itertools

import pytest
from pyspark.sql import functions as F

from actiscope.chem import graph as molecule
from actiscope.operators import substructure as sub

NAMED = {
    "aspirin": "CC(=O)Oc1ccccc1C(=O)O", "benzene": "c1ccccc1", "ethanol": "CCO", "caffeine": "Cn1c(=O)c2c(ncn2C)n(C)c1=O", "anisole": "COc1ccccc1", "nitrobenzene": "O=[N+]([O-])c1ccccc1", "sulfanilamide": "Nc1ccc(cc1)S(=O)(=O)N", "naphthalene": "c1ccc2ccccc2c1",
    "piperazine": "C1CNCCN1", "acetate": "CC(=O)[O-].[Na+]", "morpholine": "C1COCCN1", "urea": "NC(=O)N", "lactam": "O=C1CCN1", "dodecane": "CCCCCCCCCCCC", "propyne": "CC#C", "azide": "CN=[N+]=[N-]", "tolueneish": "Cc1ccc(Cl)cc1", "bad": "!!", "null": None,
}


@pytest.fixture(scope="module")
def graphs(spark):
    return spark.createDataFrame(list(NAMED.items()), "name string, smiles string").repartition(2).withColumn("g", sub.graph("smiles")).cache()


def test_fragments_of_known_molecules(graphs):
    want = {
        "aspirin": {"Ar_COO": 1, "COO": 1, "COO2": 1, "C_O": 2, "C_O_noCOO": 1, "benzene": 1, "ester": 1, "ether": 1}, "ethanol": {"Al_OH": 1, "Al_OH_noTert": 1}, "caffeine": {"Ar_N": 4, "NH0": 4, "imidazole": 1, "bicyclic": 1}, "anisole": {"benzene": 1, "ether": 1, "methoxy": 1},
        "nitrobenzene": {"NH0": 1, "benzene": 1, "nitro": 1, "nitro_arom": 1, "nitro_arom_nonortho": 1}, "sulfanilamide": {"NH2": 2, "aniline": 1, "benzene": 1, "prisulfonamd": 1, "sulfonamd": 1}, "piperazine": {"NH1": 2, "piperzine": 1}, "urea": {"C_O": 1, "C_O_noCOO": 1, "NH2": 2, "amide": 2, "priamide": 2, "urea": 1},
        "dodecane": {"unbrch_alkane": 7}, "propyne": {"term_acetylene": 1},
    }
    more = {"aspirin": {"para_hydroxylation"}, "caffeine": {"aryl_methyl"}, "nitrobenzene": {"N_O", "para_hydroxylation"}, "sulfanilamide": {"ArN", "para_hydroxylation"}, "anisole": {"para_hydroxylation"}}
    for r in graphs.select("name", F.struct(*sub.fragment_counts("g")).alias("f")).collect():
        found = {k: v for k, v in r.f.asDict().items() if v}
        if r.name in want:
            assert {k: v for k, v in found.items() if k not in more.get(r.name, ())} == want[r.name], r.name
        if r.name in ("bad", "null"):
            assert set(r.f.asDict().values()) == {None}


def test_keys_of_known_molecules(graphs):
    got = {r.name: r.k for r in graphs.select("name", sub.structural_keys("g").alias("k")).collect()}
    assert got["benzene"] == [162, 163, 165] and got["ethanol"] == [82, 109, 114, 139, 153, 155, 157, 160, 164]
    assert got["naphthalene"] == [101, 105, 125, 145, 162, 163, 165] or got["naphthalene"] == [105, 125, 145, 162, 163, 165]
    assert {49, 166, 35} <= set(got["acetate"]) and {89, 123, 139, 140, 154} <= set(got["aspirin"]) and 17 in got["propyne"]
    assert got["bad"] is None and got["null"] is None


def test_partition_of_known_molecules(spark):
    known = {
        "c1ccccc1": (1.6866, 26.442), "CCO": (-0.0014, 12.7598), "CC(=O)Oc1ccccc1C(=O)O": (1.3101, 44.7103), "Cn1c(=O)c2c(ncn2C)n(C)c1=O": (-1.0293, 51.196), "CC(C)Cc1ccc(C(C)C(=O)O)cc1": (3.0732, 61.0345), "Oc1ccccc1": (1.3922, 28.1068), "Cc1ccccc1": (1.99502, 31.179),
        "c1ccncc1": (1.0816, 24.237), "CC(=O)O": (0.0909, 12.8945), "Clc1ccccc1": (2.34, 31.452), "!!": None,
    }
    d = spark.createDataFrame([(s,) for s in known], "smiles string").coalesce(1).withColumn("g", sub.graph("smiles")).select("smiles", sub.partition("g").alias("p"))
    for r in d.collect():
        if known[r.smiles] is None:
            assert r.p is None
        else:
            assert (r.p.logp, r.p.refractivity) == pytest.approx(known[r.smiles], abs=2e-3), r.smiles


def plain(mol, atoms, bonds):
    """Sets of atoms on which a pattern lies, by trying all placements."""
    out = set()
    for place in itertools.permutations(range(len(mol)), len(atoms)):
        if all(f(mol, a) for f, a in zip(atoms, place, strict=True)) and all(g(mol.bonds[place[i]].get(place[j])) for i, j, g in bonds):
            out.add(frozenset(place))
    return out


def test_matches_equal_all_placements(graphs):
    element = lambda s, arom=None: lambda m, a: m.atoms[a].symbol == s and arom in (None, m.atoms[a].aromatic)
    single = lambda o: o in (1, molecule.AROMATIC)
    ring = lambda m, a: a in m.in_ring
    cases = {
        "C(=O)O": ([element("C", False), element("O", False), element("O", False)], [(0, 1, lambda o: o == 2), (0, 2, single)]),
        "[#7]~*~[#7]": ([element("N"), lambda m, a: True, element("N")], [(0, 1, bool), (1, 2, bool)]),
        "[!#6;R]": ([lambda m, a: m.atoms[a].symbol != "C" and ring(m, a)], []),
        "[CH3,NH2,OX1]": ([lambda m, a: not m.atoms[a].aromatic and (m.atoms[a].symbol, m.atoms[a].h) in (("C", 3), ("N", 2)) or (m.atoms[a].symbol == "O" and len(m.bonds[a]) + m.atoms[a].h == 1)], []),
        "[$(C=O);!$(C-N)]": ([lambda m, a: element("C", False)(m, a) and any(o == 2 and m.atoms[b].symbol == "O" for b, o in m.bonds[a].items()) and not any(o == 1 and m.atoms[b].symbol == "N" and not m.atoms[b].aromatic for b, o in m.bonds[a].items())], []),
        "C1CN1": ([element("C", False), element("C", False), element("N", False)], [(0, 1, single), (1, 2, single), (0, 2, single)]),
        "c:c-!@[Cl,C]": ([element("C", True), element("C", True), lambda m, a: m.atoms[a].symbol in ("Cl", "C") and not m.atoms[a].aromatic], [(0, 1, lambda o: o == molecule.AROMATIC), (1, 2, lambda o: o == 1)]),
    }
    got = {r["name"]: r for r in graphs.where("g.atoms IS NOT NULL").select("name", *[sub.matches("g", p).alias(f"m{i}") for i, p in enumerate(cases)], *[sub.count("g", p).alias(f"c{i}") for i, p in enumerate(cases)], *[sub.has("g", p).alias(f"h{i}") for i, p in enumerate(cases)]).collect()}
    for name, row in got.items():
        mol = molecule.parse(NAMED[name])
        for i, (p, (atoms, bonds)) in enumerate(cases.items()):
            want = plain(mol, atoms, bonds)
            assert {frozenset(m) for m in row[f"m{i}"]} == want and row[f"c{i}"] == len(want) and row[f"h{i}"] == bool(want), (name, p)


def test_texts_that_are_no_patterns():
    for text in ("", "C(", "C1CC", "[Qq]", "C..C", "C=", "[C"):
        with pytest.raises((ValueError, IndexError)):
            sub.parse(text)
    assert len(sub.FRAGMENTS) == 85 and len(sub.KEYS) == 163


def test_removed_groups(spark):
    canonical = lambda s: molecule.write(molecule.parse(s))
    cases = [
        ("CC(C)(C)OC(=O)NCc1ccccc1", "NCc1ccccc1", ["Boc"]), ("CC(C)(C)OC(=O)NCCNC(=O)OC(C)(C)C", "NCCN", ["Boc", "Boc"]), ("O=C(OCc1ccccc1)NCCO", "NCCO", ["Cbz"]), ("CC(C)(C)[Si](C)(C)OCCN", "OCCN", ["TBS"]), ("c1ccccc1", "c1ccccc1", []),
        ("CC(=O)OCC", "CCO", ["Acetyl"]), ("!!", None, []), (None, None, []), ("C#CCCO", "CCO", ["Alkyne_handle"]),
    ]
    d = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)], "id int, smiles string, name string")
    got = {r.id: r for r in sub.removed(d, "smiles", rounds=2).collect()}
    for i, (text, want, names) in enumerate(cases):
        assert got[i].removed == names and (got[i].clean == (want and canonical(want)) or (not names and got[i].clean == text) or want is None and got[i].clean is None), text
    nitro = sub.removed(spark.createDataFrame([("O=[N+]([O-])c1ccccc1",)], "smiles string"), "smiles", {"nitro": "[N+](=O)[O-]"}).first()
    assert nitro.clean == "c1ccccc1" and nitro.removed == ["nitro"]


def test_elements_and_forms():
    for text in ("[Xx]C", "c1cccc1", "n1cccc1", "c1ccccc1c"):
        with pytest.raises(ValueError):
            molecule.parse(text)
    for text in ("C[Hg]C", "CC[Sn](C)C", "O=C=[Ti]", "c1cc[nH]c1", "[cH-]1cccc1", "O=c1cccccc1", "[O-][n+]1ccccc1", "*c1ccccc1", "c1cc2cccc3ccc4cccc1c4c32"):
        assert molecule.write(molecule.parse(molecule.write(molecule.parse(text)))) == molecule.write(molecule.parse(text))
    ethers = molecule.parse("COC" + "COC" * 1100)
    assert len(molecule.matches(molecule.parse("COC"), ethers)) > 1000


def test_each_text_is_worked_on_once(spark):
    seen = []

    def work(texts):
        seen.extend(r.smiles for r in texts.collect())
        return texts.select("smiles", F.length("smiles").alias("n"))

    d = spark.createDataFrame([(i, ["CO", "CCO", None][i % 3]) for i in range(300)], "id int, smiles string")
    out = sub.once(d, "smiles", work)
    assert out.columns == ["id", "smiles", "n"] and sorted(seen) == ["CCO", "CO"]
    assert sorted(map(tuple, out.collect())) == [(i, s, s and len(s)) for i, s in sorted(map(tuple, d.collect()))]


def test_groups_of_repeated_texts_are_removed_once(spark, monkeypatch):
    counted, rounds = [], sub._rounds
    monkeypatch.setattr(sub, "_rounds", lambda texts, *more: counted.append(texts.count()) or rounds(texts, *more))
    d = spark.createDataFrame([(i, ["CC(=O)NC", None, "NC"][i % 3]) for i in range(90)], "id int, smiles string")
    got = {r.id: (r.clean, r.removed) for r in sub.removed(d, "smiles").collect()}
    assert counted == [2] and len(got) == 90
    for i in range(90):
        assert got[i] == [("CN", ["Acetyl"]), (None, []), ("NC", [])][i % 3] or i % 3 == 0 and got[i] == ("NC", ["Acetyl"])
