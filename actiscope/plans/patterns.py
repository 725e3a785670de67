"""Queries of substructures over a library that the parts spell: a head, a chain and a tail on a benzene ring each, thousands of distinct structures.

A part's number and size choose the pieces, so what a molecule must contain follows from its pieces, which is what the SQL adds up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diversity, molecules, substructure, tautomers
from .registry import query, read, rounded

#: What begins the chain, and what ends the ring.
HEADS = ["O", "N", "Cl", "Br", "N#C", "OC(=O)", "NC(=O)", "CO", "COC(=O)", "CS", "CC(=O)", "O=C"]
TAILS = ["O", "N", "F", "Cl", "C", "C#N", "[N+](=O)[O-]", "C(=O)O", "S(=O)(=O)N", "OC"]
#: Fragments by the heads and tails that hold one.
_HOLDS = {
    "Al_COO": ["OC(=O)", None], "Al_OH": ["O", None], "Ar_COO": [None, "C(=O)O"], "Ar_OH": [None, "O"], "COO": ["OC(=O)", "C(=O)O"], "C_O": ["OC(=O) NC(=O) COC(=O) CC(=O) O=C", "C(=O)O"], "NH2": ["N NC(=O)", "N S(=O)(=O)N"], "aldehyde": ["O=C", None], "alkyl_halide": ["Cl Br", None],
    "amide": ["NC(=O)", None], "aniline": [None, "N"], "ester": ["COC(=O)", None], "ether": ["CO COC(=O)", "OC"], "halogen": ["Cl Br", "F Cl"], "ketone": ["CC(=O)", None], "methoxy": ["CO COC(=O)", "OC"], "nitrile": ["N#C", "C#N"], "nitro": [None, "[N+](=O)[O-]"], "nitro_arom_nonortho": [None, "[N+](=O)[O-]"],
    "phenol": [None, "O"], "priamide": ["NC(=O)", None], "prisulfonamd": [None, "S(=O)(=O)N"], "sulfide": ["CS", None], "sulfonamd": [None, "S(=O)(=O)N"],
}
#: Structural keys by the heads and tails that set them.
_SETS = {
    24: [None, "[N+](=O)[O-]"], 33: [None, "S(=O)(=O)N"], 41: ["N#C", "C#N"], 42: [None, "F"], 46: ["Br", None], 49: [None, "[N+](=O)[O-]"], 60: [None, "S(=O)(=O)N"], 63: [None, "[N+](=O)[O-]"], 84: ["N NC(=O)", "N S(=O)(=O)N"], 88: ["CS", "S(=O)(=O)N"], 103: ["Cl", "Cl"],
    134: ["Cl Br", "F Cl"], 139: ["O OC(=O)", "O C(=O)O"], 154: ["OC(=O) NC(=O) COC(=O) CC(=O) O=C", "C(=O)O"], 161: ["N N#C NC(=O)", "N C#N [N+](=O)[O-] S(=O)(=O)N"], 164: ["O OC(=O) NC(=O) CO COC(=O) CC(=O) O=C", "O [N+](=O)[O-] C(=O)O S(=O)(=O)N OC"],
}


def _listed(texts: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (i + 1).cast("int"))


def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, smiles of every part."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % len(HEADS)).alias("i"), (F.floor(F.col("p_partkey") / len(HEADS)) % len(TAILS)).alias("j"), (F.col("p_size") % 30 + 1).cast("int").alias("n"))
    return p.select("id", F.concat(_listed(HEADS, F.col("i")), F.expr("repeat('C', n)"), F.lit("c1ccc("), _listed(TAILS, F.col("j")), F.lit(")cc1")).alias("smiles"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, dealt over all cores, however small the file is: few bytes and much work a row."""
    return spelled(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "id")


_PIECES = f"""h(i, head) AS (VALUES {', '.join(f"({i}, '{t}')" for i, t in enumerate(HEADS))}), t(j, tail) AS (VALUES {', '.join(f"({j}, '{t}')" for j, t in enumerate(TAILS))}),
x AS (SELECT p_partkey AS id, head, tail, p_size % 30 + 1 AS n FROM part JOIN h ON i = p_partkey % {len(HEADS)} JOIN t ON j = p_partkey // {len(HEADS)} % {len(TAILS)})"""


def _among(column: str, texts: str | None) -> str:
    return f"(CASE WHEN {column} IN ({', '.join(repr(t) for t in texts.split())}) THEN 1 ELSE 0 END)" if texts else "0"


@query(f"WITH {_PIECES} SELECT id, " + ", ".join(f"{_among('head', h)} + {_among('tail', t)} AS {name.lower()}" for name, (h, t) in _HOLDS.items()) + ", 1 AS benzene FROM x")
def fragment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*_HOLDS, "benzene"]

    def counted(texts: DataFrame) -> DataFrame:
        return texts.select("smiles", substructure.graph("smiles").alias("g")).select("smiles", *[c.alias(n.lower()) for n, c in zip(names, substructure.fragment_counts("g", names), strict=True)])

    return substructure.once(spelled(spark, sf_dir), "smiles", counted).drop("smiles")


@query(f"WITH {_PIECES}, k AS (" + " UNION ALL ".join(f"SELECT {key} AS key, sum(CASE WHEN {_among('head', h)} + {_among('tail', t)} > 0 THEN 1 ELSE 0 END)::BIGINT AS n FROM x" for key, (h, t) in _SETS.items())
       + " UNION ALL SELECT unnest([162, 163, 165]), count(*) FROM x) SELECT key, n FROM k WHERE n > 0")
def structural_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many structures set each of the keys that follow from a piece."""
    d = spelled(spark, sf_dir)
    keyed = substructure.once(d.groupBy("smiles").agg(F.count(F.lit(1)).alias("rows")), "smiles", lambda texts: texts.select("smiles", substructure.graph("smiles").alias("g")).select("smiles", substructure.structural_keys("g").alias("keys")))
    keys = keyed.select(F.explode("keys").alias("key"), "rows")
    return keys.where(F.col("key").isin([*_SETS, 162, 163, 165])).groupBy("key").agg(F.sum("rows").alias("n"))


#: Protected amines: a group's text before the nitrogen, and its name.
_GROUPS = [("CC(C)(C)OC(=O)", "Boc"), ("c1ccccc1COC(=O)", "Cbz"), ("CC(=O)", "Acetyl"), ("CC(C)(C)[Si](C)(C)", "TBS"), ("", None)]


@query(f"SELECT p_partkey AS id, 7 + p_size % 9 + 1 AS heavy, ['Boc', 'Cbz', 'Acetyl', 'TBS', ''][p_partkey % {len(_GROUPS)} + 1] AS removed FROM part")
def groups_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protected amines lose their group and nothing else."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(_listed([g for g, _ in _GROUPS], F.col("p_partkey") % len(_GROUPS)), F.lit("N"), F.expr("repeat('C', cast(p_size % 9 + 1 AS INT))"), F.lit("c1ccccc1")).alias("smiles"))
    groups = {name: substructure.REMOVED[name] for _, name in _GROUPS if name}

    def cleaned(texts: DataFrame) -> DataFrame:
        return substructure.removed(texts, "smiles", groups, 2).select("smiles", F.size(substructure.graph("clean")["atoms"]).alias("heavy"), F.array_join("removed", ",").alias("removed"))

    return substructure.once(p, "smiles", cleaned).drop("smiles")


@query(f"""WITH {_PIECES}, m(piece, w) AS (VALUES ('O', 1), ('N', 1), ('Cl', 1), ('Br', 1), ('N#C', 2), ('OC(=O)', 3), ('NC(=O)', 3), ('CO', 2), ('COC(=O)', 4), ('CS', 2), ('CC(=O)', 3), ('O=C', 2),
('F', 1), ('C', 1), ('C#N', 2), ('[N+](=O)[O-]', 3), ('C(=O)O', 3), ('S(=O)(=O)N', 4), ('OC', 2))
SELECT count(*) AS rows, count(DISTINCT (head, tail, n)) AS structures, round(avg(n + 6 + a.w + b.w), 6) AS heavy FROM x JOIN m a ON a.piece = head JOIN m b ON b.piece = tail""")
def library_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct structures by canonical text, and their mean size."""
    d = library(spark, sf_dir).select(molecules.canonical("smiles").alias("text"), molecules.descriptors("smiles").alias("d"))
    return rounded(d.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("text").alias("structures"), F.avg("d.heavy_atoms").alias("heavy")))


#: Two spellings of tautomers of one compound each, after a chain of carbon.
_SHIFTED = [("c1ccc(O)nc1", "c1ccc(=O)[nH]c1"), ("C(=O)CC(C)=O", "C(O)=CC(C)=O"), ("C(=O)N", "C(O)=N"), ("c1cnc[nH]1", "c1c[nH]cn1")]


@query("SELECT count(*) AS rows, count(DISTINCT (p_partkey % 4, p_partkey // 4 % 2, p_size % 12)) AS forms, count(DISTINCT (p_partkey % 4, p_size % 12)) AS compounds FROM part")
def tautomer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures that differ in a proton's place have one canonical tautomer."""
    p = read(spark, sf_dir, "part").select(F.expr("repeat('C', cast(p_size % 12 + 1 AS INT))").alias("chain"), (F.col("p_partkey") % 4).alias("i"), (F.floor(F.col("p_partkey") / 4) % 2).alias("side"))
    ends = [_listed([pair[k] for pair in _SHIFTED], F.col("i")) for k in (0, 1)]
    d = p.select(F.concat("chain", F.when(F.col("side") == 0, ends[0]).otherwise(ends[1])).alias("smiles"))
    out = tautomers.canonicalised(d, "smiles").withColumn("form", molecules.canonical("smiles"))
    return out.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("form").alias("forms"), F.countDistinct("tautomer").alias("compounds"))


@query("""WITH x AS (SELECT p_partkey % 3 AS library, p_partkey % 4 = 0 AS open, p_size % 5 AS n FROM part), g AS (SELECT library, open, n, count(*) AS c FROM x GROUP BY ALL),
r AS (SELECT library, sum(c) AS m, count(*) AS k, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM g WHERE NOT open GROUP BY library), t AS (SELECT library, sum(c) AS n FROM g GROUP BY library)
SELECT library, n::BIGINT AS n, coalesce(k, 0) AS n_scaffolds, round(coalesce(k, 0) / n, 6) AS scaffold_diversity, round((n - coalesce(m, 0)) / n, 6) AS acyclic_fraction, round(coalesce(h, 0), 6) AS scaffold_entropy FROM t LEFT JOIN r USING (library)""")
def scaffold_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three libraries of rings that a chain joins, and of chains."""
    p = read(spark, sf_dir, "part").select((F.col("p_partkey") % 3).alias("library"), F.expr("repeat('C', cast(p_size % 5 + 1 AS INT))").alias("chain"), (F.col("p_partkey") % 4 == 0).alias("open"))
    d = p.select("library", F.when(F.col("open"), F.concat(F.lit("O"), "chain")).otherwise(F.concat(F.lit("Oc1ccc("), "chain", F.lit("c2ccccc2)cc1"))).alias("smiles"))
    return rounded(diversity.scaffold_figures(d.select("library", molecules.scaffold("smiles").alias("s")), "s", "library"))


# What heads, tails (with the ring atom that bears them) and chains add by the published contributions of their atoms.
_HEAD_LOGP = {"O": -0.5570, "N": -0.5906, "Cl": 0.6895, "Br": 0.8456, "N#C": 0.01678, "OC(=O)": -0.4222, "NC(=O)": -1.0215, "CO": 0.0971, "COC(=O)": -0.3338, "CS": 0.8137, "CC(=O)": 0.0822, "O=C": -0.3079}
_TAIL_LOGP = {"O": -0.0133, "N": -0.4147, "F": 0.4118, "Cl": 0.9345, "C": 0.58952, "C#N": 0.15278, "[N+](=O)[O-]": -0.0887, "C(=O)O": -0.0207, "S(=O)(=O)N": -1.0715, "OC": 0.2897}


@query(f"""WITH {_PIECES}, a(head, u) AS (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in _HEAD_LOGP.items())}), b(tail, v) AS (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in _TAIL_LOGP.items())}),
c AS (SELECT id, n, u + v + 1.2604 + n * 0.246 AS s, head IN ('O', 'N', 'Cl', 'Br', 'CO', 'CS') AS beside FROM x JOIN a USING (head) JOIN b USING (tail))
SELECT id, round(s + CASE WHEN n = 1 THEN -0.0516 ELSE CASE WHEN beside THEN -0.2035 ELSE 0.1441 END + (n - 2) * 0.1441 - 0.0516 END, 4) AS logp FROM c""")
def partition_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    parted = lambda texts: texts.select("smiles", substructure.graph("smiles").alias("g")).select("smiles", substructure.partition("g")["logp"].alias("logp"))
    return rounded(substructure.once(spelled(spark, sf_dir), "smiles", parted).drop("smiles"), 4)
