"""Structure checks and fragment choice on SMILES text, with expressions only: atoms are tokens, fragments are parts between dots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An atom: a bracket, or an element of the organic subset (aromatic ones are lower case).
ATOM = r"\[[^\]]+\]|Br|Cl|[BCNOPSFI]|[bcnops]"
#: The element within a bracket, after its mass number.
SYMBOL = r"^\[[0-9]*([A-Z][a-z]?|se|as|[bcnops])"


def atoms(smiles: Column) -> Column:
    return F.regexp_extract_all(smiles, F.lit(f"({ATOM})"), F.lit(1))


def elements(smiles: Column) -> Column:
    """The element symbol of each atom, hydrogens included if they are written as atoms."""
    return F.transform(atoms(smiles), lambda a: F.initcap(F.when(a.startswith("["), F.regexp_extract(a, SYMBOL, 1)).otherwise(a)))


def heavy_atoms(smiles: Column) -> Column:
    return F.size(F.filter(elements(smiles), lambda e: e != "H"))


def charge(smiles: Column) -> Column:
    """Net formal charge: +, ++, +2, - and so on within brackets."""
    signs = F.regexp_extract_all(smiles, F.lit(r"([+-]+[0-9]*)(?::[0-9]+)?\]"), F.lit(1))
    one = lambda s: F.when(s.rlike("[0-9]"), F.regexp_extract(s, "([0-9]+)", 1).cast("int")).otherwise(F.length(s)) * F.when(s.startswith("+"), 1).otherwise(-1)
    return F.aggregate(F.transform(signs, one), F.lit(0), lambda a, b: a + b)


def largest_fragment(smiles: Column) -> Column:
    """The part with most heavy atoms, ties to the longer, then to the later in code point order."""
    parts = F.transform(F.split(smiles, r"\."), lambda p: F.struct(heavy_atoms(p).alias("n"), F.length(p).alias("l"), p.alias("p")))
    return F.array_max(parts)["p"]


def issues(df: DataFrame, idx: str, smiles: str, least: int = 3, most: int = 150) -> DataFrame:
    """idx, code, fatal: a row per rule that a structure breaks; a null or atomless structure only is unparseable."""
    s = F.col(smiles)
    found, organic = elements(s), F.array(*[F.lit(e) for e in ("H", "B", "C", "N", "O", "F", "Si", "P", "S", "Cl", "Se", "Br", "I")])
    n = F.size(F.filter(found, lambda e: e != "H"))
    opened, closed = F.length(s) - F.length(F.replace(s, F.lit("("))), F.length(s) - F.length(F.replace(s, F.lit(")")))
    bad = s.isNull() | (F.size(found) < 1) | (opened != closed) | s.rlike(r"[!?$&{}~]")
    rules = {
        "mixture": s.contains("."), "inorganic": F.size(F.array_except(found, organic)) > 0, "no_carbon": ~F.array_contains(found, "C"),
        "isotope": s.rlike(r"\[[0-9]"), "too_small": n < least, "too_large": n > most, "charged": charge(s) != 0,
    }
    codes = F.when(bad, F.array(F.lit("unparseable"))).otherwise(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])))
    return df.select(idx, F.explode(codes).alias("code")).withColumn("fatal", F.col("code") != "charged")


def valid(df: DataFrame, idx: str, smiles: str) -> DataFrame:
    """The rows without a fatal issue."""
    return df.join(issues(df, idx, smiles).where("fatal").select(idx).distinct(), idx, "left_anti")
