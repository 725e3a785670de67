"""Structures in a column: parsing, standard forms, scaffolds, fingerprints, descriptors, matched pairs, substituents.

Every function takes a SMILES column and gives a column; the work is done in Arrow batches by `chem`, a worker remembers the structures that it
has seen.  Null and text that is no molecule give null (`valid` gives false), so filters can be pushed where they belong.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..chem import features, graph, standard

DESCRIPTORS = tuple(features.describe(graph.parse("CCO")))
TOPOLOGY = tuple(features.topology(graph.parse("CCO")))


#: Structures that a worker remembers.
MOST = 50_000


@functools.lru_cache(MOST)
def _read(smiles: str) -> graph.Mol | None:
    try:
        return graph.parse(smiles)
    except ValueError:
        return None


def _column(kind: str, f: Callable[[graph.Mol], object]) -> Callable[[Column | str], Column]:
    """An Arrow function of a SMILES column."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = _remembered(f, None)
        for s in batches:
            yield pd.Series([one(x) for x in s], dtype=object)

    work.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return lambda smiles: F.pandas_udf(work, kind)(smiles)  # made when it is called: workers import this module, too


def _table(kind: str, f: Callable[[graph.Mol], dict]) -> Callable[[Column | str], Column]:
    """As _column, for a struct."""
    names = [part.split()[0] for part in kind.split(", ")]

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = _remembered(lambda mol: tuple(f(mol).get(n) for n in names), (None,) * len(names))
        for s in batches:
            yield pd.DataFrame([one(x) for x in s], columns=names, dtype=object)

    work.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return lambda smiles: F.pandas_udf(work, kind)(smiles)  # made when it is called: workers import this module, too


def _remembered(f: Callable[[graph.Mol], object], without: object) -> Callable[[object], object]:
    """f of a text's molecule, or `without`; a task keeps the results of MOST texts."""

    @functools.lru_cache(MOST)
    def one(smiles: str) -> object:
        mol = _read(smiles)
        return without if mol is None else f(mol)

    return lambda x: one(x) if isinstance(x, str) else without


def _text(mol: graph.Mol | None) -> str | None:
    return None if mol is None else graph.write(mol)


canonical = _column("string", graph.write)
formula = _column("string", features.formula)
parent = _column("string", lambda m: _text(standard.parent(m)))
neutralised = _column("string", lambda m: _text(standard.neutralised(m)))
standardised = _column("string", lambda m: _text(standard.standardised(m)))
deprotected = _column("string", lambda m: _text(standard.deprotected(m)[0]))
protecting_groups = _column("array<string>", lambda m: standard.deprotected(m)[1])
deglycosylated = _column("string", lambda m: _text(standard.deglycosylated(m)))
sugar_rings = _column("int", lambda m: len(standard.sugars(m)))
scaffold = _column("string", lambda m: _text(standard.scaffold(m)) or "")
generic_scaffold = _column("string", lambda m: _text(standard.scaffold(m, True)) or "")
structure_issues = _column("array<string>", standard.issues)
descriptors = _table(", ".join(f"{n} double" for n in DESCRIPTORS), features.describe)
topology = _table(", ".join(f"{n} double" for n in TOPOLOGY), features.topology)
edges = _column("array<struct<a:int,b:int,bond:int>>", lambda m: [{"a": a, "b": b, "bond": o} for a, b, o in m.edges()])
sentence = _column("array<string>", lambda m: [str(c) for c, v in features.environments(m, 1).items() for _ in v])


def environments(smiles: Column | str, size: int = 2048) -> Column:
    """The atoms around which each bit of a circular fingerprint of that size lies."""
    return _column("array<struct<bit:int,centre:int,radius:int>>", lambda m: [{"bit": c % size, "centre": a, "radius": r} for c, v in features.environments(m).items() for a, r in v])(smiles)


def cuts(smiles: Column | str, most: int = 1, heavy: int = 13) -> Column:
    """What `standard.cuts` gives: the ways to cut up to `most` bonds, whose variable part has at most `heavy` atoms."""
    return _column("array<struct<constant:string,variable:string>>", lambda m: [{"constant": a, "variable": b} for a, b in standard.cuts(m, most, heavy)])(smiles)


def valid(smiles: Column | str) -> Column:
    return canonical(smiles).isNotNull()


def fingerprint(smiles: Column | str, kind: str = "morgan", size: int = 2048) -> Column:
    """The set bits, ascending: morgan, feature_morgan, path, layered, pattern, atom_pair, torsion, pharmacophore; mhfp and map4 give hash values. Structural keys: `substructure`."""
    if kind in ("mhfp", "map4"):
        return _column("array<long>", lambda m: getattr(features, kind)(m, size))(smiles)
    if kind not in features.KINDS:
        raise ValueError(f"no fingerprint {kind}")
    return _column("array<int>", lambda m: features.bits(m, kind, size))(smiles)


def counted(smiles: Column | str, kind: str = "morgan", size: int = 2048) -> Column:
    """bit -> count."""
    return _column("map<int,int>", lambda m: features.counts(m, kind, size))(smiles)


def dense(bits: Column | str, size: int = 2048) -> Column:
    """Set bits as an array of 0 and 1."""
    on = F.col(bits) if isinstance(bits, str) else bits
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(on, i).cast("int"))


def combined(parts: list[tuple[Column, int]]) -> Column:
    """Fingerprints one after the other: (bits, size) each, shifted by the sizes before."""
    moved = lambda bits, by: F.transform(bits, lambda b: b + F.lit(by))
    before = [sum(size for _, size in parts[:i]) for i in range(len(parts))]
    return F.concat(*[moved(bits, by) for (bits, _), by in zip(parts, before, strict=True)])


# The rule of five's limits.
LIPINSKI = {"mol_weight": 500.0, "donors": 5.0, "acceptors": 10.0, "logp": 5.0}


def passes_lipinski(d: Column, logp: Column | None = None) -> Column:
    """At most one of the rules broken: weight 500, donors 5, acceptors 10 and, where it is given (`substructure.partition`), logp 5."""
    values = {name: d[name] for name in LIPINSKI if name != "logp"} | ({} if logp is None else {"logp": logp})
    return sum(((v > LIPINSKI[name]).cast("int") for name, v in values.items()), F.lit(0)) <= 1


#: Molecules of a constant part that meet in one task.
MET = 2000


def matched_pairs(df: DataFrame, idx: str, smiles: str, value: str, most: int = 1, heavy: int = 13) -> DataFrame:
    """constant, a_id, b_id, a_variable, b_variable, delta (b less a): molecules that differ in what hangs on up to `most` cut bonds, hydrogen included.

    The cuts meet by constant part: a join of rows, never of all molecules.  The molecules of a common constant part (one that a third of all share is nothing unusual) are dealt over
    several tasks by a salt: each task has a part of them on one side and all on the other.  delta is null where a value is. Rows without an id are left out.
    """
    cut = df.where(F.col(idx).isNotNull()).select(F.col(idx).alias("id"), F.col(value).cast("double").alias("value"), F.explode(cuts(smiles, most, heavy)).alias("c")).select("id", "value", "c.*")
    parts = cut.groupBy("constant").agg(F.ceil(F.count(F.lit(1)) / MET).cast("int").alias("parts")).where("parts > 1").withColumnRenamed("constant", "p_constant")
    salted = cut.join(parts, F.col("constant") == F.col("p_constant"), "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop("p_constant")
    side = lambda p, salt: salted.select(F.col("id").alias(f"{p}_id"), F.col("value").alias(f"{p}_value"), F.col("variable").alias(f"{p}_variable"), "constant", salt.alias("salt"))
    a = side("a", F.pmod(F.xxhash64("id", "variable"), F.col("parts")).cast("int"))
    b = side("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    j = a.join(b, ["constant", "salt"]).where((F.col("a_id") < F.col("b_id")) & (F.col("a_variable") != F.col("b_variable")))
    return j.select("constant", "a_id", "b_id", "a_variable", "b_variable", (F.col("b_value") - F.col("a_value")).alias("delta")).distinct()


def transformations(pairs: DataFrame) -> DataFrame:
    """from, to, n, mean, sd of the change of each transformation, the smaller text first."""
    turn = F.col("a_variable") > F.col("b_variable")
    d = pairs.select(F.least("a_variable", "b_variable").alias("from"), F.greatest("a_variable", "b_variable").alias("to"), F.when(turn, -F.col("delta")).otherwise(F.col("delta")).alias("d"))
    return d.where("d IS NOT NULL").groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))


def decomposed(df: DataFrame, idx: str, smiles: str, core: str) -> DataFrame:
    """idx, position, substituent of the molecules that contain a core; a position without a substituent has no row."""
    pattern = graph.parse(core)
    found = _column("map<int,string>", lambda m: standard.substituents(m, pattern))
    return df.select(idx, F.explode(found(smiles)).alias("position", "substituent"))


def scaffold_groups(df: DataFrame, smiles: str, value: str) -> DataFrame:
    """scaffold, n, mean, spread and share of the rows; rings are none in ''."""
    g = df.withColumn("scaffold", scaffold(smiles)).where("scaffold IS NOT NULL").groupBy("scaffold").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("spread"))
    every = Window.partitionBy()  # a row per scaffold
    return g.withColumn("share", F.col("n") / F.sum("n").over(every))


def scaffold_summary(groups: DataFrame) -> DataFrame:
    """n, scaffolds, singletons, largest, entropy (bits) and the share of scaffolds among rows."""
    p = F.col("share")
    a = groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("scaffolds"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"), (-F.sum(p * F.log2(p))).alias("entropy"))
    return a.withColumn("diversity", F.col("scaffolds") / F.col("n"))
