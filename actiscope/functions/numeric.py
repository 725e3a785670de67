"""Column builders used by many operators. Division is by zero-safe: an undefined ratio is null, or the stated default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def square(x: Column) -> Column:
    return x * x


# Concentration units in molar, by size, then by spelling.
MOLAR = {"M": 1.0, "mol/L": 1.0, "molar": 1.0, "mM": 1e-3, "microM": 1e-6, "uM": 1e-6, "µM": 1e-6, "nM": 1e-9, "pM": 1e-12, "fM": 1e-15}
#: Avogadro's number (1/mol) and the temperature at which free energies are stated (K).
AVOGADRO, ROOM_TEMPERATURE = 6.02214076e23, 298.15


def molar(value: Column, unit: Column) -> Column:
    """A concentration in molar; an unknown unit is an error."""
    table = F.create_map(*[F.lit(x) for pair in MOLAR.items() for x in pair])
    return value * F.coalesce(table[unit], F.raise_error(F.concat(F.lit("unknown unit "), unit)).cast("double"))


def p_activity(value: Column, unit: Column) -> Column:
    """-log10 of the molar concentration; null where that isn't positive."""
    m = molar(value, unit)
    return F.when(m > 0, -F.log10(m))


def from_p_activity(p: Column, unit: str = "nM") -> Column:
    """The concentration of a p-scale value in a unit."""
    if unit not in MOLAR:
        raise ValueError(f"unknown unit {unit}")
    return F.pow(F.lit(10.0), -p) / F.lit(MOLAR[unit])


def converted(value: Column, unit: Column, to: str) -> Column:
    """A concentration in another unit; an unknown unit is an error."""
    if to not in MOLAR:
        raise ValueError(f"unknown unit {to}")
    return molar(value, unit) / F.lit(MOLAR[to])


def delta_g(p: Column, temperature: float = 298.15, joules: bool = False) -> Column:
    """Free energy of binding in kcal (or kJ) per mole."""
    gas = 8.314462618e-3 if joules else 1.987204259e-3
    return -F.lit(2.302585092994046 * gas * temperature) * p
