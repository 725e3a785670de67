"""Canonical tautomers: all forms that proton shifts reach, as a fixpoint of joins, and the one of the best score.

The forms of all structures are one table.  A round shifts the newest forms, keeps those that their structure doesn't have yet, and ends in a checkpoint; it ends
when none is new, so the number of rounds is the longest chain of shifts, not the number of forms.  Structures are taken once each, however many rows have them.

Scores are sums of published terms, counted by `substructure` patterns: aromatic rings, carbonyl and like groups, methyl, and so on.  Of equal scores the smallest canonical text is taken.

Null and text that is no molecule have a null tautomer; a structure without shifts has itself, in canonical text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..chem import graph, tautomer
from . import substructure
from .clustering import _cut
from .molecules import _column, canonical

# The published terms of a tautomer's score: pattern and weight.
TERMS = [
    ("[#6]1([#6]=[#6][#6]([#6]=[#6]1)=,:[N,S,O])=,:[N,S,O]", 25), ("[#6]=[N][OH]", 4), ("[#6]=,:[#8]", 2), ("[#7]=,:[#8]", 2), ("[#15]=,:[#8]", 2), ("[C]=[!#1;!#6]", 1), ("[C](=[!#1;!#6])[!#1;!#6]", 2), ("[c]=!@[N]", -1),
    ("[CX4H3]", 1), ("[#7]C(=[NR0])[#7H0]", 1), ("[#7;R][#6;R]([N])=[#7;R]", 2), ("[#6]=[N+]([O-])[OH]", -4), ("[P,S,Se,Te;H1]", -1), ("[P,S,Se,Te;H2]", -2),
]
# An aromatic ring's weight, and what one of carbon alone adds.
RING, CARBON_RING = 100, 150


def score(g: str) -> Column:
    """A tautomer's score, from its graph column."""
    parts = [substructure.count(g, pattern) * weight for pattern, weight in TERMS]
    for n in range(5, 8):
        parts += [substructure.count(g, f"a1{':a' * (n - 2)}:a1") * RING, substructure.count(g, f"c1{':c' * (n - 2)}:c1") * CARBON_RING]
    return sum(parts[1:], parts[0])


shifted = _column("array<string>", lambda m: [graph.write(t) for t in tautomer.shifts(m)])


def forms(df: DataFrame, smiles: str) -> DataFrame:
    """start (canonical text of each structure of df), form: all forms that shifts reach, the start included."""
    start = df.select(canonical(smiles).alias("start")).where("start IS NOT NULL").distinct()
    known = _cut(start.select("start", F.col("start").alias("form")))
    fresh = known
    while fresh.limit(1).count():
        reached = fresh.select("start", F.explode(shifted("form")).alias("form")).distinct()
        fresh = _cut(reached.join(known, ["start", "form"], "left_anti"))
        known = _cut(known.unionByName(fresh))
    return known


def canonicalised(df: DataFrame, smiles: str) -> DataFrame:
    """df with tautomer: the best form's canonical text."""
    found = forms(df, smiles)
    # A form that several structures reach is scored once.
    scored = found.select("form").distinct().select("form", substructure.graph("form").alias("g")).select(F.col("form").alias("s_form"), score("g").alias("score"))
    best = found.join(scored, F.col("form") == F.col("s_form")).groupBy("start").agg(F.min_by("form", F.struct((-F.col("score")).alias("s"), F.col("form").alias("f"))).alias("tautomer"))
    names = df.columns
    keyed = df.withColumn("tautomer_start", canonical(smiles))
    return keyed.join(best, F.col("tautomer_start") == F.col("start"), "left").select(*names, "tautomer")
