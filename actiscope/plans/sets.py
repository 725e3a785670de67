"""Sets of molecules and of features that steps carry on: `molecules(...) >> keep_if(...) >> featurize(...) >> split(...)`.

A set is a lazy frame with the names of its columns and the history of its steps; targets are a column, so they stay aligned whatever is filtered or joined.  A step is made
for one kind of set and refuses the other; chains of steps are steps.  Nothing runs until `collect` or a model is fitted, so Catalyst sees a chain as one plan.

Text that is no molecule stays in a set of molecules as a row with `valid` false until `drop_invalid`; predicates see valid rows only, `keep_if` drops the others and `drop_if`
keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distances, domain, isolation, models, molecules as mol, splits, substructure

#: The sets of descriptors by name: their columns from a text column (and the name of a graph column).
DESCRIPTIONS: dict[str, Callable[[str], Column]] = {"physicochemical": mol.descriptors, "constitutional": mol.descriptors, "topological": mol.topology}


@dataclass(frozen=True)
class _Set:
    frame: DataFrame
    idx: str = "id"
    y: str | None = None
    history: tuple[str, ...] = ()

    def __rshift__(self, step: Step) -> Any:
        if not isinstance(step, Step):
            return NotImplemented
        return step(self)

    def __gt__(self, other: object) -> bool:
        raise TypeError("steps are joined by >>, not by >")

    def collect(self, as_frame: bool = False) -> Any:
        """The rows, or a pandas frame."""
        return self.frame.toPandas() if as_frame else self.frame.collect()

    def to_dot(self) -> str:
        """The steps so far as a Graphviz graph."""
        names = [n.replace("\\", "\\\\").replace('"', '\\"') for n in ("input", *self.history)]
        return "\n".join(["digraph set {", *(f'  n{i} [label="{n}"];' for i, n in enumerate(names)), *(f"  n{i} -> n{i + 1};" for i in range(len(names) - 1)), "}"])


@dataclass(frozen=True)
class MoleculeSet(_Set):
    """A frame with a text column of structures and, beside it, whether it is a molecule."""

    smiles: str = "smiles"

    def to_frame(self, properties: Sequence[str] | None = None) -> DataFrame:
        """id, text, target and other columns (all, if none are named)."""
        named = [c for c in (self.idx, self.smiles, self.y) if c]
        return self.frame.select(*named, *[c for c in (properties if properties is not None else self.frame.columns) if c not in (*named, "valid")])


@dataclass(frozen=True)
class FeatureSet(_Set):
    """A frame with a column of feature arrays, whose names are in order."""

    x: str = "features"
    names: tuple[str, ...] = ()

    def shape(self) -> tuple[int, int]:
        return self.frame.count(), len(self.names)

    def to_frame(self) -> DataFrame:
        """A column a feature, under its name."""
        kept = [c for c in (self.idx, self.y) if c]
        return self.frame.select(*kept, *[F.get(self.x, F.lit(i)).alias(n) for i, n in enumerate(self.names)])


@dataclass(frozen=True)
class Step:
    """A function of a set; takes: the kinds of sets that it is for."""

    name: str
    run: Callable[[Any], Any]
    takes: tuple[type, ...] = (MoleculeSet, FeatureSet)
    nodes: tuple[str, ...] = field(default=())

    def __call__(self, of: _Set) -> Any:
        if not isinstance(of, self.takes):
            raise TypeError(f"{self.name} is for {' or '.join(t.__name__ for t in self.takes)}, not for {type(of).__name__}")
        out = self.run(of)
        return replace(out, history=(*of.history, *(self.nodes or (self.name,)))) if isinstance(out, _Set) else out

    def __rshift__(self, other: Step) -> Step:
        if not isinstance(other, Step):
            return NotImplemented

        def both(s: Any) -> Any:
            middle = self.run(s)
            if not isinstance(middle, other.takes):
                raise TypeError(f"{other.name} isn't for what {self.name} gives")
            return other.run(middle)

        return Step(f"{self.name} >> {other.name}", both, self.takes, (*(self.nodes or (self.name,)), *(other.nodes or (other.name,))))


def _maker(takes: tuple[type, ...]) -> Callable:
    def make(f: Callable[..., Any]) -> Callable[..., Step]:
        def bound(*args: Any, **params: Any) -> Step:
            shown = ", ".join([*(getattr(a, "__name__", repr(a)) for a in args), *(f"{k}={v!r}" for k, v in params.items())])
            return Step(f"{f.__name__}({shown})", lambda s: f(s, *args, **params), takes)

        bound.__name__, bound.__doc__ = f.__name__, f.__doc__
        return bound

    return make


#: Decorators: a function (set, parameters...) becomes a maker of steps.
step, feature_step = _maker((MoleculeSet,)), _maker((FeatureSet,))


def chain(*steps: Step) -> Step:
    """Several steps as one."""
    out = steps[0]
    for s in steps[1:]:
        out = out >> s
    return out


def from_frame(df: DataFrame, smiles: str = "smiles", idx: str = "id", y: str | None = None, on_error: str = "keep") -> MoleculeSet:
    """A set of a table's structures. on_error: keep rows without a molecule, drop them, or raise when they are met."""
    out = df.withColumn("valid", mol.valid(smiles))
    if on_error == "drop":
        out = out.where("valid")
    elif on_error == "raise":
        out = out.withColumn("valid", F.when(F.col("valid"), True).otherwise(F.raise_error(F.concat(F.lit("no molecule: "), F.coalesce(smiles, F.lit("null")))).cast("boolean")))
    elif on_error != "keep":
        raise ValueError(f"no policy {on_error}")
    return MoleculeSet(out, idx, y, (), smiles)


def molecules(spark: SparkSession, texts: Sequence[str | None], y: Sequence[float] | None = None) -> MoleculeSet:
    """A set of given texts, numbered from 0; targets must be as many."""
    if y is not None and len(y) != len(texts):
        raise ValueError(f"{len(texts)} structures and {len(y)} targets")
    rows = [(i, t, None if y is None else float(y[i])) for i, t in enumerate(texts)]
    return from_frame(spark.createDataFrame(rows, "id long, smiles string, y double"), y="y" if y is not None else None)


def check(s: MoleculeSet, least: int = 1) -> MoleculeSet:
    """The set itself; ValueError with the first ten ids without a molecule, or for fewer rows than `least`."""
    bad = [r[0] for r in s.frame.where("NOT valid").select(s.idx).orderBy(s.idx).limit(10).collect()]
    if bad:
        raise ValueError(f"no molecule at {bad}")
    if s.frame.limit(least).count() < least:
        raise ValueError(f"fewer than {least} molecules")
    return s


@step
def drop_invalid(s: MoleculeSet) -> MoleculeSet:
    return replace(s, frame=s.frame.where("valid"))


@step
def keep_if(s: MoleculeSet, predicate: Callable[[Column], Column]) -> MoleculeSet:
    """Valid rows whose text column the predicate (of a column) holds for."""
    return replace(s, frame=s.frame.where(F.col("valid") & F.coalesce(predicate(F.col(s.smiles)), F.lit(False))))


@step
def drop_if(s: MoleculeSet, predicate: Callable[[Column], Column]) -> MoleculeSet:
    """All rows but the valid ones that the predicate holds for."""
    return replace(s, frame=s.frame.where(~(F.col("valid") & F.coalesce(predicate(F.col(s.smiles)), F.lit(False)))))


@step
def filter_by_property(s: MoleculeSet, **ranges: tuple[float | None, float | None]) -> MoleculeSet:
    """Rows whose descriptors lie in closed ranges: mol_weight=(100, 500), heavy_atoms=(None, 30); None is no bound."""
    unknown = set(ranges) - set(mol.DESCRIPTORS)
    if unknown:
        raise ValueError(f"no descriptors {sorted(unknown)}")
    d = s.frame.withColumn("set_d", mol.descriptors(s.smiles)).where("valid")
    for name, (low, high) in ranges.items():
        value = F.col(f"set_d.{name}")
        d = d.where((value >= low if low is not None else F.lit(True)) & (value <= high if high is not None else F.lit(True)))
    return replace(s, frame=d.drop("set_d"))


@step
def apply(s: MoleculeSet, f: Callable[[Column], Column]) -> MoleculeSet:
    """The texts that a function of a column gives; rows that it leaves without a molecule are invalid."""
    d = s.frame.withColumn(s.smiles, F.when(F.col("valid"), f(F.col(s.smiles))))
    return replace(s, frame=d.withColumn("valid", mol.valid(s.smiles)))


@step
def contains(s: MoleculeSet, smarts: str) -> MoleculeSet:
    """Rows in which a pattern matches."""
    d = s.frame.where("valid").withColumn("set_g", substructure.graph(s.smiles)).where(substructure.has("set_g", smarts))
    return replace(s, frame=d.drop("set_g"))


@step
def featurize(s: MoleculeSet, kind: str = "morgan", size: int = 2048) -> FeatureSet:
    """The bits of a fingerprint as features; rows without a molecule have none and are left out."""
    d = s.frame.where("valid").withColumn("set_bits", mol.fingerprint(s.smiles, kind, size))
    d = d.withColumn("features", mol.dense("set_bits", size).cast("array<double>")).drop("set_bits")
    return FeatureSet(d, s.idx, s.y, (), "features", tuple(f"{kind}_{i}" for i in range(size)))


@step
def describe(s: MoleculeSet, kind: str = "physicochemical") -> FeatureSet:
    """Descriptors as features; fragments: the counts of all fragments."""
    if kind == "fragments":
        x = F.array(*[c.cast("double") for c in substructure.fragment_counts("set_g")])
        d = substructure.once(s.frame.where("valid"), s.smiles, lambda texts: texts.withColumn("set_g", substructure.graph(s.smiles)).select(s.smiles, x.alias("features")))
        return FeatureSet(d, s.idx, s.y, (), "features", tuple(substructure.FRAGMENTS))
    if kind not in DESCRIPTIONS:
        raise ValueError(f"no descriptors {kind}")
    names = mol.TOPOLOGY if kind == "topological" else mol.DESCRIPTORS
    d = s.frame.where("valid").withColumn("set_d", DESCRIPTIONS[kind](s.smiles))
    return FeatureSet(d.withColumn("features", F.array(*[F.col(f"set_d.{n}") for n in names])).drop("set_d"), s.idx, s.y, (), "features", tuple(names))


def split(test_share: float = 0.2, how: str = "random", **options: Any) -> Step:
    """(train, test): random by id, scaffold (groups of one scaffold stay together), or kennard_stone and maxmin on features."""

    def run(s: Any) -> tuple[Any, Any]:
        if how == "scaffold":
            if not isinstance(s, MoleculeSet):
                raise TypeError("a scaffold split is for molecules")
            marks = splits.group_fill(s.frame.where("valid").select(s.idx, mol.scaffold(s.smiles).alias("scaffold")), "scaffold", test_share).select(F.col(s.idx).alias("set_id"), "is_test")
        elif how in ("kennard_stone", "maxmin"):
            if not isinstance(s, FeatureSet):
                raise TypeError(f"{how} is for features")
            marks = distances.diverse_split(s.frame, s.idx, s.x, test_share, how, **options).select(F.col(s.idx).alias("set_id"), "is_test")
        elif how == "random":
            marks = splits.random_split(s.frame, s.idx, test_share, **options).select(F.col(s.idx).alias("set_id"), "is_test")
        else:
            raise ValueError(f"no split {how}")
        j = s.frame.join(marks, F.col(s.idx) == F.col("set_id")).drop("set_id")
        return tuple(replace(s, frame=j.where(F.col("is_test") == t).drop("is_test"), history=(*s.history, f"split({how})")) for t in (False, True))

    return Step(f"split({test_share}, {how})", run)


def _target(s: FeatureSet) -> str:
    if s.y is None:
        raise ValueError("the set has no target")
    return s.y


@feature_step
def fit(s: FeatureSet, kind: str = "forest", task: str = "auto", **options: Any) -> models.Fitted:
    """A fitted learner. auto: classes if the target is whole numbers of at most max(2, square root of the rows) values."""
    y = _target(s)
    if task == "auto":
        n, distinct, whole = s.frame.where(F.col(y).isNotNull()).agg(F.count(F.lit(1)), F.countDistinct(y), F.bool_and(F.col(y) == F.floor(y))).first()
        task = "classes" if whole and distinct <= max(2, n**0.5) else "values"
    return models.fitted(s.frame, s.x, y, kind, task == "classes", **options)


@feature_step
def cross_validate(s: FeatureSet, kind: str = "forest", folds: int = 5, **options: Any) -> Any:
    return models.cross_validated(s.frame, s.idx, s.x, _target(s), kind, folds=folds, **options)


#: Domains by name: functions of (training rows, rows, id, features).
DOMAINS: dict[str, Callable[..., DataFrame]] = {"range": domain.range_domain, "distance": domain.distance_domain, "leverage": domain.leverage_domain, "knn": distances.knn_domain, "density": distances.density_domain, "components": distances.component_domain, "isolation": isolation.isolation_domain}


@feature_step
def applicability_domain(s: FeatureSet, rows: FeatureSet, method: str = "knn", **options: Any) -> DataFrame:
    """What a domain of the set's rows says of other rows: id, score and `inside`."""
    if method not in DOMAINS:
        raise ValueError(f"no domain {method}; there are {sorted(DOMAINS)}")
    return DOMAINS[method](s.frame, rows.frame, s.idx, s.x, **options)


def coverage(decided: DataFrame) -> DataFrame:
    """One row: the share of rows that a domain has inside."""
    return decided.agg(F.avg(F.col("inside").cast("double")).alias("coverage"))
