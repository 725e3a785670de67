"""Queries on structures: four series of six small molecules, dealt over the parts by number, and literal probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..chem import features
from ..operators import molecules, similarity, splits
from .registry import query, read, rounded

# Benzoic acids, anilides, pyridine carboxamides, benzimidazoles.
SERIES = """OC(=O)c1ccccc1 OC(=O)c1ccc(C)cc1 OC(=O)c1ccc(Cl)cc1 OC(=O)c1ccc(Br)cc1 OC(=O)c1ccc(OC)cc1 OC(=O)c1ccc(N)cc1
CC(=O)Nc1ccccc1 CC(=O)Nc1ccc(C)cc1 CC(=O)Nc1ccc(Cl)cc1 CC(=O)Nc1ccc(F)cc1 CC(=O)Nc1ccc(OC)cc1 CC(=O)Nc1ccc(O)cc1
NC(=O)c1ccncc1 NC(=O)c1ccc(C)nc1 NC(=O)c1ccc(Cl)nc1 NC(=O)c1ccc(OC)nc1 CNC(=O)c1ccncc1 CCNC(=O)c1ccncc1
c1ccc2[nH]cnc2c1 Cc1ccc2[nH]cnc2c1 Clc1ccc2[nH]cnc2c1 COc1ccc2[nH]cnc2c1 Cn1cnc2ccccc21 CCn1cnc2ccccc21""".split()

# Fixed values, known of these molecules: number, atoms of C, H, N, O, F, Cl, Br, polar surface, donors, acceptors, rotatable bonds, rings.
_KNOWN = """k(i, c, h, n, o, f, cl, br, tpsa, donors, acceptors, rotatable, rings) AS (VALUES
    (0, 7, 6, 0, 2, 0, 0, 0, 37.3, 1, 1, 1, 1), (1, 8, 8, 0, 2, 0, 0, 0, 37.3, 1, 1, 1, 1), (2, 7, 5, 0, 2, 0, 1, 0, 37.3, 1, 1, 1, 1), (3, 7, 5, 0, 2, 0, 0, 1, 37.3, 1, 1, 1, 1),
    (4, 8, 8, 0, 3, 0, 0, 0, 46.53, 1, 2, 2, 1), (5, 7, 7, 1, 2, 0, 0, 0, 63.32, 2, 2, 1, 1), (6, 8, 9, 1, 1, 0, 0, 0, 29.1, 1, 1, 1, 1), (7, 9, 11, 1, 1, 0, 0, 0, 29.1, 1, 1, 1, 1),
    (8, 8, 8, 1, 1, 0, 1, 0, 29.1, 1, 1, 1, 1), (9, 8, 8, 1, 1, 1, 0, 0, 29.1, 1, 1, 1, 1), (10, 9, 11, 1, 2, 0, 0, 0, 38.33, 1, 2, 2, 1), (11, 8, 9, 1, 2, 0, 0, 0, 49.33, 2, 2, 1, 1),
    (12, 6, 6, 2, 1, 0, 0, 0, 55.98, 1, 2, 1, 1), (13, 7, 8, 2, 1, 0, 0, 0, 55.98, 1, 2, 1, 1), (14, 6, 5, 2, 1, 0, 1, 0, 55.98, 1, 2, 1, 1), (15, 7, 8, 2, 2, 0, 0, 0, 65.21, 1, 3, 2, 1),
    (16, 7, 8, 2, 1, 0, 0, 0, 41.99, 1, 2, 1, 1), (17, 8, 10, 2, 1, 0, 0, 0, 41.99, 1, 2, 2, 1), (18, 7, 6, 2, 0, 0, 0, 0, 28.68, 1, 1, 0, 2), (19, 8, 8, 2, 0, 0, 0, 0, 28.68, 1, 1, 0, 2),
    (20, 7, 5, 2, 0, 0, 1, 0, 28.68, 1, 1, 0, 2), (21, 8, 8, 2, 1, 0, 0, 0, 37.91, 1, 2, 1, 2), (22, 8, 8, 2, 0, 0, 0, 0, 17.82, 0, 1, 0, 2), (23, 9, 10, 2, 0, 0, 0, 0, 17.82, 0, 1, 1, 2))"""
_MASS = "c * 12.011 + h * 1.008 + n * 14.007 + o * 15.999 + f * 18.998 + cl * 35.453 + br * 79.904"
_PART = "x AS (SELECT p_partkey AS id, (p_partkey % 24)::INTEGER AS i, p_retailprice AS y FROM part)"


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, smiles, y: every part with the structure of its number modulo 24."""
    every = F.array(*[F.lit(s) for s in SERIES])
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(every, (F.col("p_partkey") % 24 + 1).cast("int")).alias("smiles"), F.col("p_retailprice").alias("y"))


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (the series' number), smiles, y: the parts' distinct structures with their mean price."""
    d = structures(spark, sf_dir).withColumn("i", (F.col("id") % 24).cast("int"))
    return d.groupBy(F.col("i").alias("id"), "smiles").agg(F.avg("y").alias("y"))


@query(f"""WITH {_KNOWN}, {_PART}
SELECT id, round({_MASS}, 6) AS mol_weight, tpsa, donors::DOUBLE AS donors, acceptors::DOUBLE AS acceptors, rotatable::DOUBLE AS rotatable_bonds, rings::DOUBLE AS rings, (c + n + o + f + cl + br)::DOUBLE AS heavy_atoms,
  (n + o + f + cl + br)::DOUBLE AS hetero_atoms, h::DOUBLE AS hydrogens, (f + cl + br)::DOUBLE AS halogens, true AS drug_like FROM x JOIN k USING (i)""")
def molecule_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = structures(spark, sf_dir).select("id", molecules.descriptors("smiles").alias("d")).withColumn("drug_like", molecules.passes_lipinski(F.col("d")))
    return rounded(d.select("id", *[f"d.{n}" for n in ("mol_weight", "tpsa", "donors", "acceptors", "rotatable_bonds", "rings", "heavy_atoms", "hetero_atoms", "hydrogens", "halogens")], "drug_like"))


@query(f"""WITH {_KNOWN}, {_PART}, e AS (SELECT id, [('C', c), ('H', h), ('Br', br), ('Cl', cl), ('F', f), ('N', n), ('O', o)] AS es FROM x JOIN k USING (i))
SELECT id, list_aggregate([z[1] || CASE WHEN z[2]::INTEGER > 1 THEN z[2]::VARCHAR ELSE '' END for z in [[u[1]::VARCHAR, u[2]::VARCHAR] for u in es] if z[2] <> '0'], 'string_agg', '') AS formula FROM e""")
def molecule_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures(spark, sf_dir).select("id", molecules.formula("smiles").alias("formula"))


_SCAFFOLD = "s AS (SELECT id, y, CASE WHEN i < 12 THEN 'c1ccccc1' WHEN i < 18 THEN 'c1ccncc1' ELSE 'c1ccc2[nH]cnc2c1' END AS scaffold FROM x)"


@query(f"WITH {_PART}, {_SCAFFOLD} SELECT scaffold, count(*) AS n, round(avg(y), 6) AS mean, round(max(y) - min(y), 6) AS spread, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY scaffold")
def scaffold_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(molecules.scaffold_groups(structures(spark, sf_dir), "smiles", "y"))


@query(f"""WITH {_PART}, {_SCAFFOLD}, g AS (SELECT scaffold, count(*) AS n FROM s GROUP BY scaffold)
SELECT (SELECT count(*) FROM s) AS n, count(*) AS scaffolds, count(*) FILTER (n = 1) AS singletons, max(n) AS largest, round(-sum(n / (SELECT count(*) FROM s) * log2(n / (SELECT count(*) FROM s))), 6) AS entropy, round(count(*) / (SELECT count(*) FROM s), 6) AS diversity FROM g""")
def scaffold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(molecules.scaffold_summary(molecules.scaffold_groups(structures(spark, sf_dir), "smiles", "y")))


@query(f"""WITH {_PART}, {_SCAFFOLD}, g AS (SELECT scaffold, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, scaffold) AS r FROM s GROUP BY scaffold),
t AS (SELECT (SELECT count(*) FROM s) - round_even((SELECT count(*) FROM s) * 0.2, 0)::BIGINT AS t, max(n) FILTER (r = 1) AS a, max(n) FILTER (r = 2) AS b, max(n) FILTER (r = 3) AS c FROM g),
u AS (SELECT t, a, b, c, CASE WHEN a <= t THEN a ELSE 0 END AS ua FROM t), v AS (SELECT *, CASE WHEN ua + b <= t THEN ua + b ELSE ua END AS ub FROM u)
SELECT id, scaffold, CASE r WHEN 1 THEN a > t WHEN 2 THEN ua + b > t ELSE ub + c > t END AS is_test FROM s JOIN g USING (scaffold), v""")
def split_scaffold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = structures(spark, sf_dir).select("id", molecules.scaffold("smiles").alias("scaffold"))
    return splits.group_fill(d, "scaffold", 0.2)


#: Text, its standard form, and its parent without protecting groups and sugars.
PROBES = [
    ("CC(=O)Oc1ccccc1C(=O)[O-].[Na+]", "CC(=O)Oc1ccccc1C(=O)O", "CC(=O)Oc1ccccc1C(=O)O", 0),
    ("OCC", "CCO", "CCO", 0), ("C1=CC=CC=C1", "c1ccccc1", "c1ccccc1", 0), ("C[NH3+].[Cl-]", "CN", "CN", 0),
    ("CC(C)(C)OC(=O)NCc1ccccc1", "CC(C)(C)OC(=O)NCc1ccccc1", "NCc1ccccc1", 0),
    ("OCC1OC(Oc2ccccc2)C(O)C(O)C1O", "OCC1OC(Oc2ccccc2)C(O)C(O)C1O", "Oc1ccccc1", 1),
    ("O=[N+]([O-])c1ccccc1", "[O-][N+](=O)c1ccccc1", "[O-][N+](=O)c1ccccc1", 0),
    ("CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "Cn1cnc2c1c(=O)n(C)c(=O)n2C", "Cn1cnc2c1c(=O)n(C)c(=O)n2C", 0), ("!!bad!!", None, None, None), ("CC(", None, None, None), (None, None, None, None),
]
_text = lambda v: "NULL" if v is None else f"'{v}'"


@query("WITH t(i, standard, bare, sugars, valid) AS (VALUES " + ", ".join(f"({i}, {_text(b)}, {_text(c)}, {'NULL' if d is None else d}, {str(b is not None).lower()})" for i, (_, b, c, d) in enumerate(PROBES)) + f") SELECT c_custkey AS id, standard, bare, sugars, valid FROM customer JOIN t ON c_custkey % {len(PROBES)} = i")
def standard_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with one of the probes."""
    listed = F.array(*[F.lit(p[0]) for p in PROBES])
    d = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % len(PROBES)).cast("int").alias("i"))
    s = molecules.standardised("smiles")
    d = d.withColumn("smiles", F.get(listed, F.col("i"))).select("id", "i", "smiles", s.alias("standard"))
    # The spelling of a form is the canonical one of this package, so forms are compared with the known ones by their canonical text.
    known = spark.createDataFrame([(i, p[1], p[2]) for i, p in enumerate(PROBES)], "i int, known string, known_bare string")
    bare = molecules.deglycosylated(molecules.deprotected("standard"))
    j = d.join(F.broadcast(known), "i").select("id", "smiles", "standard", "known", "known_bare", bare.alias("bare"))
    same = lambda found, told: F.when(F.col(found).eqNullSafe(molecules.canonical(told)), F.col(told)).otherwise(F.col(found)).alias(found)
    return j.select("id", same("standard", "known"), same("bare", "known_bare"), molecules.sugar_rings("standard").alias("sugars"), molecules.valid("smiles").alias("valid"))


_KINDS = sorted([*features.KINDS, "mhfp", "map4"])
#: Two spellings of one molecule each.
SPELLINGS = [("c1ccccc1C(=O)O", "OC(=O)C1=CC=CC=C1"), ("Cn1cnc2ccccc21", "C1=CC=C2C(=C1)N=CN2C"), ("CC(=O)Nc1ccc(O)cc1", "Oc1ccc(NC(C)=O)cc1"), ("NC(=O)c1ccc(C)nc1", "Cc1ccc(cn1)C(N)=O")]


@query(f"SELECT kind, count(*) AS rows, count(DISTINCT c_custkey % {len(SPELLINGS)}) AS molecules, count(DISTINCT (c_custkey % {len(SPELLINGS)}, c_custkey // {len(SPELLINGS)} % 2)) AS spellings FROM customer, (VALUES {', '.join(f'({k!r})' for k in _KINDS)}) k(kind) GROUP BY kind")
def fingerprint_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with one of two spellings of a molecule each: every kind of fingerprint tells the molecules apart, and not the spellings."""
    n = len(SPELLINGS)
    side = lambda k: F.get(F.array(*[F.lit(p[k]) for p in SPELLINGS]), (F.col("c_custkey") % n).cast("int"))
    d = read(spark, sf_dir, "customer").select(F.when(F.floor(F.col("c_custkey") / n) % 2 == 0, side(0)).otherwise(side(1)).alias("smiles"))
    out = None
    for kind in _KINDS:
        bits = molecules.fingerprint("smiles", kind, 64 if kind in ("mhfp", "map4") else 2048)
        one = d.select("smiles", bits.alias("bits")).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("rows"), F.countDistinct("bits").alias("molecules"), F.countDistinct("smiles").alias("spellings"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_PART}, c AS (SELECT i, count(*) AS n FROM x GROUP BY i) SELECT sum(n * n)::BIGINT - sum(n)::BIGINT AS twins FROM c""")
def structure_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pairs of different parts with one structure, by fingerprint: the series' 24 fingerprints are all different."""
    f = structures(spark, sf_dir).select(molecules.fingerprint("smiles").alias("bits")).groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    return f.agg((F.sum(F.col("n") * F.col("n")) - F.sum("n")).alias("twins"))


# What hangs on the benzene ring of each acid and anilide, the series' common group first.
_R = "r(i, substituent) AS (VALUES " + ", ".join(f"({i}, '[*]C(=O)O')" for i in range(6)) + ", " + ", ".join(f"({i}, '[*]NC(C)=O')" for i in range(6, 12)) + ", (1, '[*]C'), (2, '[*]Cl'), (3, '[*]Br'), (4, '[*]OC'), (5, '[*]N'), (7, '[*]C'), (8, '[*]Cl'), (9, '[*]F'), (10, '[*]OC'), (11, '[*]O'))"


@query(f"WITH {_R}, {_PART} SELECT substituent, count(*) AS n, round(avg(y), 6) AS mean FROM x JOIN r USING (i) GROUP BY substituent")
def substituent_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = structures(spark, sf_dir).where(F.col("id") % 24 < 12)
    r = molecules.decomposed(d, "id", "smiles", "c1ccccc1").join(d.select("id", "y"), "id")
    known = {s: s for s in ("[*]C(=O)O", "[*]NC(C)=O", "[*]C", "[*]Cl", "[*]Br", "[*]OC", "[*]N", "[*]F", "[*]O")}
    spelled = F.create_map(*[x for s in known for x in (F.lit(_canonical(s)), F.lit(s))])
    r = r.withColumn("substituent", F.coalesce(spelled[F.col("substituent")], F.col("substituent")))
    return rounded(r.groupBy("substituent").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")))


def _canonical(smiles: str) -> str:
    from ..chem import graph

    return graph.write(graph.parse(smiles))


@query(f"""WITH {_PART}, a AS (SELECT i, avg(y) AS y FROM x GROUP BY i), p(x, z) AS (VALUES (1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5))
SELECT count(*) AS n, round(avg(v.y - u.y), 6) AS mean FROM p JOIN a u ON u.i = p.x JOIN a v ON v.i = p.z""")
def acid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched pairs of the parts' acids, with their mean prices, whose constant part is 4-substituted benzoic acid; without hydrogen as a substituent."""
    pairs = molecules.matched_pairs(_means(spark, sf_dir).where("id < 6"), "id", "smiles", "y").where((F.col("constant") == _canonical("OC(=O)c1ccc([*])cc1")) & (F.col("a_id") > 0))
    return rounded(pairs.agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean")))


@query(f"WITH {_PART} SELECT count(DISTINCT i) AS queries, count(DISTINCT i) AS same_series FROM x")
def series_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other of each of the parts' distinct molecules is of its own series."""
    f = _means(spark, sf_dir).select("id", molecules.fingerprint("smiles").alias("bits"))
    near = similarity.nearest(f, f, 1)
    return near.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.floor(F.col("query_id") / 6) == F.floor(F.col("ref_id") / 6)).alias("same_series"))
