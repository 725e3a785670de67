"""Substructure search as expressions: patterns become columns over a molecule's atoms and neighbours.

`graph(smiles)` is a struct of a molecule's atoms and of each atom's neighbours, read once.  A pattern in the usual line notation becomes one expression over
it: partial matches are arrays of atom numbers, and every pattern atom extends each of them by the neighbours that its bond and atom allow.  So a search
needs no shuffle and no Python: any number of patterns are columns of one projection, and filters on them are filters.  A pattern is searched only where
the molecule has its elements and as many atoms (the screen, three comparisons).

Notation: element symbols, `#n`, `*`, `a`, `A`, `D`, `X`, `v`, `H`, `R`, `r`, `x`, charges and isotopes, combined by `!`, `&`, `,`, `;`; bonds `-`, `=`, `#`, `:`, `~`, `@` and their
combinations, branches, ring closures, and conditions on an atom's surroundings `$(...)`.  Marks of stereo are read as single bonds or ignored.
`R` counts rings of the smallest set, `x` ring bonds.  ValueError for text that is no pattern.

Defined cases: null and text that is no molecule have a graph of nulls, so counts and matches are null and `has` is null (which a filter drops).
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..chem import graph as molecule

_ATOM = "z:int,arom:boolean,h:int,charge:int,degree:int,valence:int,rings:int,ring_bonds:int,isotope:int,sizes:array<int>"
GRAPH = f"struct<atoms:array<struct<{_ATOM}>>,near:array<array<struct<a:int,o:int,ring:boolean>>>,elements:array<int>,fragments:int>"


def _graph(mol: molecule.Mol) -> tuple:
    rings = mol.rings
    atoms, near = [], []
    for a, (x, n) in enumerate(zip(mol.atoms, mol.bonds, strict=True)):
        own = [r for r in rings if a in r]
        used = sum(1.5 if o == molecule.AROMATIC else o for o in n.values())
        sides = [{"a": b, "o": o, "ring": frozenset((a, b)) in mol.ring_bonds} for b, o in sorted(n.items())]
        atoms.append({"z": molecule.NUMBER.get(x.symbol, 0), "arom": x.aromatic, "h": x.h, "charge": x.charge, "degree": len(n), "valence": int(used) + x.h, "rings": len(own), "ring_bonds": sum(s["ring"] for s in sides), "isotope": x.isotope, "sizes": sorted({len(r) for r in own})})
        near.append(sides)
    return atoms, near, sorted({y["z"] for y in atoms}), len(mol.components())


def graph(smiles: Column | str) -> Column:
    """A molecule's atoms and neighbours: the struct that the patterns of this module are searched in."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for text in s:
                try:
                    rows.append(_graph(molecule.parse(text)) if isinstance(text, str) else (None,) * 4)
                except ValueError:
                    rows.append((None,) * 4)
            yield pd.DataFrame(rows, columns=["atoms", "near", "elements", "fragments"], dtype=object)

    work.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # Called non-deterministic so that the optimizer leaves it where it is: many columns read it, and it must run once.
    return F.pandas_udf(work, GRAPH).asNondeterministic()(smiles)


def once(df: DataFrame, smiles: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns that `work` adds to a table of its distinct texts: each text is read and searched once, however many rows have it.

    Few bytes and much work a text: they are dealt over all cores, however few there are. Null texts have nulls.
    """
    spark = df.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # By a hash: partitions by the text itself are those of distinct(), which are merged where they are small.
    found = work(df.where(F.col(smiles).isNotNull()).select(smiles).distinct().repartition(tasks, F.xxhash64(smiles)))
    return df.join(found, smiles, "left").select(*df.columns, *[c for c in found.columns if c != smiles])


#: A condition as SQL text: on an atom, from the names of a graph and of the atom's number; on a bond, from one of an atom's neighbours.
Condition = Callable[[str, str], str]
Bond = Callable[[str], str]
_names = itertools.count()


@dataclass
class Pattern:
    """Atoms by condition; bonds to earlier atoms: the first of each atom but the first leads to it, the others close rings."""

    atoms: list[Condition] = field(default_factory=list)
    bonds: list[list[tuple[int, Bond]]] = field(default_factory=list)
    elements: set[int] = field(default_factory=set)

    def found(self, g: str, start: str | None = None) -> str:
        """All matches, an array of arrays of atom numbers in the pattern's order; start: the atoms that the first may lie on."""
        i = f"i{next(_names)}"
        out = f"transform(filter({start or f'sequence(0, size({g}.atoms) - 1)'}, {i} -> {self.atoms[0](g, i)}), {i} -> array({i}))"
        for atom, ((first, bond), *closing) in zip(self.atoms[1:], self.bonds[1:], strict=True):
            m, e = (f"{k}{next(_names)}" for k in "me")
            fits = f"filter({g}.near[{m}[{first}]], {e} -> {bond(e)} AND NOT array_contains({m}, {e}.a) AND {atom(g, f'{e}.a')})"
            out = f"flatten(transform({out}, {m} -> transform({fits}, {e} -> concat({m}, array({e}.a)))))"
            for other, ring in closing:
                m, e = (f"{k}{next(_names)}" for k in "me")
                out = f"filter({out}, {m} -> exists({g}.near[{m}[{other}]], {e} -> {e}.a = element_at({m}, -1) AND {ring(e)}))"
        return out

    def screen(self, g: str) -> str:
        """Whether a molecule has what it must have to be searched."""
        return " AND ".join([f"size({g}.atoms) >= {len(self.atoms)}", *(f"array_contains({g}.elements, {z})" for z in sorted(self.elements))])


_ORDERS = {"-": 1, "/": 1, "\\": 1, "=": 2, "#": 3, "$": 4, ":": molecule.AROMATIC}
_PRIMITIVE = re.compile(r"#(\d+)|([DXvRrxH])(\d*)|(\+\d+|\++|-\d+|-+)|(\d+)|(:\d+)|(@{1,2})|([A-Z][a-z]?|se|as|te|[bcnops])|([*])")
_CHAIN = re.compile(r"\[|Br|Cl|[BCNOPSFIbcnops*aA]|%\d\d|\d|[()]|[-=#$:~@!/\\&,;]+|\.")


def _logic(text: str, primitive: Callable[[str, int], tuple[Callable, int]]) -> Callable:
    """A combination of conditions: `;` binds least, then `,`, then `&` and nothing, then `!`."""
    for mark in ";,":
        parts, depth, last = [], 0, 0
        for i, ch in enumerate(text):
            depth += (ch == "(") - (ch == ")")
            if ch == mark and not depth:
                parts.append(text[last:i])
                last = i + 1
        if parts:
            inner = [_logic(p, primitive) for p in [*parts, text[last:]]]
            return lambda *at: "(" + (" AND " if mark == ";" else " OR ").join(f(*at) for f in inner) + ")"
    i, terms = 0, []
    while i < len(text):
        negated = False
        while i < len(text) and text[i] in "!&":
            negated ^= text[i] == "!"
            i += 1
        term, i = primitive(text, i)
        terms.append((term, negated))
    if not terms:
        raise ValueError("an empty condition")
    return lambda *at: "(" + " AND ".join(f"NOT {f(*at)}" if no else f(*at) for f, no in terms) + ")"


def _bond(text: str | None) -> Bond:
    if not text:
        return lambda e: f"{e}.o IN (1, {molecule.AROMATIC})"

    def primitive(t: str, i: int) -> tuple[Bond, int]:
        if t[i] == "~":
            return lambda e: "true", i + 1
        if t[i] == "@":
            return lambda e: f"{e}.ring", i + 1
        if t[i] not in _ORDERS:
            raise ValueError(f"{text!r} is no bond")
        return lambda e: f"({e}.o = {_ORDERS[t[i]]})", i + 1

    return _logic(text, primitive)


def _atom(test: str) -> Condition:
    """A test of an atom's fields, x in the text."""
    return lambda g, i: "(" + re.sub(r"\bx\b", f"{g}.atoms[{i}]", test) + ")"


def _symbol(name: str) -> tuple[Condition, int | None]:
    if name == "*":
        return lambda g, i: "true", None
    if name in ("a", "A"):
        return _atom("x.arom" if name == "a" else "NOT x.arom"), None
    z = molecule.NUMBER.get(name.capitalize())
    if z is None:
        raise ValueError(f"{name} is no element")
    return _atom(f"x.z = {z} AND {'' if name.islower() else 'NOT '}x.arom"), z


def _bracket(text: str) -> tuple[Condition, int | None]:
    """The condition of a bracket atom, and the element that it must be, where that is plain."""
    hydrogen = re.fullmatch(r"\d*H[+-]?", text) is not None

    def primitive(t: str, i: int) -> tuple[Condition, int]:
        if t.startswith("$(", i):
            depth, j = 1, i + 2
            while depth:
                depth += (t[j] == "(") - (t[j] == ")")
                j += 1
            around = parse(t[i + 2 : j - 1])
            return lambda g, k: f"(size({around.found(g, f'array({k})')}) > 0)", j
        if t[i : i + 1] in ("a", "A") and t[i : i + 2] not in molecule.NUMBER and t[i : i + 2] != "as":
            return _symbol(t[i])[0], i + 1
        m = _PRIMITIVE.match(t, i)
        if not m:
            raise ValueError(f"[{text}] is no atom")
        number, letter, n, charge, isotope, mapped, stereo, symbol, star = m.groups()
        if number:
            return _atom(f"x.z = {number}"), m.end()
        if mapped or stereo or star:
            return lambda g, k: "true", m.end()
        if charge:
            amount = (int(charge[1:]) if charge[1:].isdigit() else len(charge)) * (1 if charge[0] == "+" else -1)
            return _atom(f"x.charge = {amount}"), m.end()
        if isotope:
            return _atom(f"x.isotope = {isotope}"), m.end()
        if letter and t[i : i + 2] in molecule.NUMBER and t[i + 1 : i + 2].islower():  # Rb, Xe, Dy ...
            return _symbol(t[i : i + 2])[0], i + 2
        if letter == "H" and hydrogen:
            return _atom("x.z = 1"), m.end()
        if letter:
            if not n and letter in "Rrx":
                return _atom("x.rings > 0"), m.end()
            tests = {"D": "x.degree = ", "X": "x.degree + x.h = ", "v": "x.valence = ", "H": "x.h = ", "R": "x.rings = ", "x": "x.ring_bonds = "}
            return _atom(f"array_contains(x.sizes, {n})" if letter == "r" else tests[letter] + (n or "1")), m.end()
        if len(symbol) == 2 and symbol[0].isupper() and symbol not in molecule.NUMBER:
            return _symbol(symbol[0])[0], i + 1
        return _symbol(symbol)[0], m.end()

    plain = re.fullmatch(r"(?:#(\d+)|(Cl|Br|Si|[BCNOPSFI]|[bcnops]))(?:[HDXvRrx]\d*|[+-]\d*)*", text)
    z = None
    if plain:
        z = int(plain[1]) if plain[1] else molecule.NUMBER[plain[2].capitalize()]
    return _logic(text, primitive), z


@functools.lru_cache(None)
def parse(smarts: str) -> Pattern:
    """The pattern of a text."""
    out, stack, rings = Pattern(), [], {}
    last, bond, i = None, None, 0
    while i < len(smarts):
        m = _CHAIN.match(smarts, i)
        if not m:
            raise ValueError(f"{smarts!r} is no pattern")
        t, i = m[0], m.end()
        if t == "(":
            stack.append(last)
        elif t == ")":
            last = stack.pop()
        elif t == ".":
            raise ValueError("patterns of several parts aren't searched")
        elif t[0] in "-=#$:~@!/\\&,;":
            bond = t
        elif t[0] == "%" or t.isdigit():
            name = t.lstrip("%")
            if name in rings:
                other, mark = rings.pop(name)
                # The later atom of the two checks the bond.
                a, b = max(last, other), min(last, other)
                out.bonds[a].append((b, _bond(bond or mark)))
            else:
                rings[name] = last, bond
            bond = None
        else:
            if t == "[":
                depth, j = 1, i
                while depth:
                    depth += (smarts[j] == "[") - (smarts[j] == "]")
                    j += 1
                (condition, z), i = _bracket(smarts[i : j - 1]), j
            else:
                condition, z = _symbol(t)
            out.atoms.append(condition)
            out.bonds.append([] if last is None else [(last, _bond(bond))])
            out.elements |= {z} if z else set()
            last, bond = len(out.atoms) - 1, None
    if not out.atoms or stack or rings or bond:
        raise ValueError(f"{smarts!r} isn't complete")
    return out


def _searched(g: str, smarts: str, result: str, without: str) -> Column:
    """An expression (with {} for all matches) of the molecules that pass the screen; `without` of the others."""
    p = parse(smarts)
    return F.expr(f"CASE WHEN {g}.atoms IS NULL THEN NULL WHEN {p.screen(g)} THEN {result.format(p.found(g))} ELSE {without} END")


def matches(g: str, smarts: str) -> Column:
    """All matches in a graph column (its name), each an array of atom numbers in the pattern's order; symmetric ones are separate."""
    return _searched(g, smarts, "{}", "cast(array() AS array<array<int>>)")


def count(g: str, smarts: str) -> Column:
    """How many sets of atoms match."""
    return _searched(g, smarts, "size({})" if len(parse(smarts).atoms) == 1 else "size(array_distinct(transform({}, m -> array_sort(m))))", "0")


def has(g: str, smarts: str, times: int = 1) -> Column:
    """Whether a pattern matches, `times` sets of atoms at least."""
    return count(g, smarts) >= times if times > 1 else _searched(g, smarts, "size({}) > 0", "false")


# The published fragment patterns, by name.
FRAGMENTS = {
    "Al_COO": "C-C(=O)[O;H1,-]", "Al_OH": "[C!$(C=O)]-[OH]", "Al_OH_noTert": "[$(C-[OX2H]);!$([CX3](-[OX2H])=[OX1]);!$([CD4]-[OX2H])]", "ArN": "[$(a-[NX3H2]),$(a-[NH1][NH2]),$(a-C(=[OX1])[NH1][NH2]),$(a-C(=[NH])[NH2])]",
    "Ar_COO": "c-C(=O)[O;H1,-]", "Ar_N": "n", "Ar_NH": "[nH]", "Ar_OH": "c[OH1]", "COO": "[#6]C(=O)[O;H,-1]", "COO2": "[CX3](=O)[OX1H0-,OX2H1]", "C_O": "[CX3]=[OX1]", "C_O_noCOO": "[C!$(C-[OH])]=O", "C_S": "C=[SX1]", "HOCCN": "[$([OX2H1][CX4][CX4H2][NX3&R1]),$([OH1][CX4][CX4H2][NX3][CX4](C)(C)C)]",
    "Imine": "[Nv3](=C)-[#6]", "NH0": "[NH0,nH0]", "NH1": "[NH1,nH1]", "NH2": "[NH2,nH2]", "N_O": "[NX3,NX4]-[OX1,OX2H1]", "Ndealkylation1": "[$(N(-[CH3])-C-[$(C~O),$(C-a),$(C-N),$(C=C)]),$(N(-[CH2][CH3])-C-[$(C~O),$(C-a),$(C-N),$(C=C)])]", "Ndealkylation2": "[$([N&R1]1(-C)CCC1),$([N&R1]1(-C)CCCC1),$([N&R1]1(-C)CCCCC1),$([N&R1]1(-C)CCCCCC1),$([N&R1]1(-C)CCCCCCC1)]",
    "Nhpyrrole": "[nH]", "SH": "[SH]", "aldehyde": "[CX3H1](=O)[#6]", "alkyl_carbamate": "C[NH1]C(=O)OC", "alkyl_halide": "[CX4]-[Cl,Br,I,F]", "allylic_oxid": "[$(C=C-C);!$(C=C-C-[N,O,S]);!$(C=C-C-C-[N,O]);!$(C12=CC(=O)CCC1C3C(C4C(CCC4)CC3)CC2)]", "amide": "C(=O)-N", "amidine": "C(=N)(-N)-[!#7]",
    "aniline": "c-[NX3;!$(N=*)]", "aryl_methyl": "[$(a-[CH3]),$(a-[CH2]-[CH3]),$(a-[CH2]-[CH2]~[!N;!O]);!$(a(:a!:*):a!:*)]", "azide": "[$(*-[NX2-]-[NX2+]#[NX1]),$(*-[NX2]=[NX2+]=[NX1-])]", "azo": "[#6]-N=N-[#6]", "barbitur": "C1C(=O)NC(=O)NC1=O", "benzene": "c1ccccc1", "benzodiazepine": "[c&R2]12[c&R1][c&R1][c&R1][c&R1][c&R2]1[N&R1][C&R1][C&R1][N&R1]=[C&R1]2",
    "bicyclic": "[R2][R2]", "diazo": "[N+]#N", "dihydropyridine": "[$([NX3H1]1-C=C-C-C=C1),$([Nv3]1=C-C-C=C-C1),$([Nv3]1=C-C=C-C-C1),$([NX3H1]1-C-C=C-C=C1)]", "epoxide": "O1CC1", "ester": "[#6][CX3](=O)[OX2H0][#6]", "ether": "[OD2]([#6])[#6]", "furan": "o1cccc1", "guanido": "C(=N)(N)N", "halogen": "[#9,#17,#35,#53]",
    "hdrzine": "[NX3]-[NX3]", "hdrzone": "C=N-[NX3]", "imidazole": "n1cncc1", "imide": "N(-C(=O))-C=O", "isocyan": "N=C=O", "isothiocyan": "N=C=S", "ketone": "[#6][CX3](=O)[#6]", "ketone_Topliss": "[$([CX3](=[OX1])(C)([c,C]));!$([CX3](=[OX1])([CH1]=C)[c,C])]", "lactam": "N1C(=O)CC1", "lactone": "[C&R1](=O)[O&R1][C&R1]",
    "methoxy": "[OX2](-[#6])-[CH3]", "morpholine": "O1CCNCC1", "nitrile": "[NX1]#[CX2]", "nitro": "[$([NX3](=O)=O),$([NX3+](=O)[O-])][!#8]", "nitro_arom": "[$(c1(-[$([NX3](=O)=O),$([NX3+](=O)[O-])])ccccc1)]", "nitro_arom_nonortho": "[$(c1(-[$([NX3](=O)=O),$([NX3+](=O)[O-])])ccccc1);!$(cc-!:*)]", "nitroso": "[N!$(N-O)]=O", "oxazole": "c1ocnc1",
    "oxime": "[CX3]=[NX2]-[OX2]", "para_hydroxylation": "[$([cH]1[cH]cc(c[cH]1)~[$([#8,$([#8]~[H,c,C])])]),$([cH]1[cH]cc(c[cH]1)~[$([#7X3,$([#7](~[H,c,C])~[H,c,C])])]),$([cH]1[cH]cc(c[cH]1)-!:[$([NX3H,$(NC(=O)[H,c,C])])])]", "phenol": "[OX2H]-c1ccccc1", "phenol_noOrthoHbond": "[$(c1(-[OX2H])ccccc1);!$(cc-!:[CH2]-[OX2H]);!$(cc-!:C(=O)[O;H1,-]);!$(cc-!:C(=O)-[NH2])]",
    "phos_acid": "[$(P(=[OX1])([$([OX2H]),$([OX1-]),$([OX2]P)])([$([OX2H]),$([OX1-]),$([OX2]P)])[$([OX2H]),$([OX1-]),$([OX2]P)]),$([P+]([OX1-])([$([OX2H]),$([OX1-]),$([OX2]P)])([$([OX2H]),$([OX1-]),$([OX2]P)])[$([OX2H]),$([OX1-]),$([OX2]P)])]",
    "phos_ester": "[$(P(=[OX1])([OX2][#6])([$([OX2H]),$([OX1-]),$([OX2][#6])])[$([OX2H]),$([OX1-]),$([OX2][#6]),$([OX2]P)]),$([P+]([OX1-])([OX2][#6])([$([OX2H]),$([OX1-]),$([OX2][#6])])[$([OX2H]),$([OX1-]),$([OX2][#6]),$([OX2]P)])]",
    "piperdine": "N1CCCCC1", "piperzine": "N1CCNCC1", "priamide": "C(=O)-[NH2]", "prisulfonamd": "[NH2]-S(=,-[OX1;+0,-1])(=,-[OX1;+0,-1])-[#6]", "pyridine": "n1ccccc1", "quatN": "[$([NX4+]),$([NX4]=*)]", "sulfide": "[SX2](-[#6])-C", "sulfonamd": "N-S(=,-[OX1;+0,-1])(=,-[OX1;+0,-1])-[#6]", "sulfone": "S(=,-[OX1;+0,-1])(=,-[OX1;+0,-1])(-[#6])-[#6]",
    "term_acetylene": "C#[CH]", "tetrazole": "c1nnnn1", "thiazole": "c1scnc1", "thiocyan": "S-C#N", "thiophene": "s1cccc1", "unbrch_alkane": "[R0;D2][R0;D2][R0;D2][R0;D2]", "urea": "C(=O)(-N)-N",
}


def fragment_counts(g: str, names: list[str] | None = None) -> list[Column]:
    """A count of each fragment, by its name (all, if none are named)."""
    return [count(g, FRAGMENTS[n]).alias(n) for n in names or FRAGMENTS]


def _rings(least: int, most: int) -> str:
    return "[" + ",".join(f"$([R]@1{'@[R]' * (n - 2)}@[R]1)" for n in range(least, most + 1)) + "]"


# The published structural keys 1 to 166: (pattern, how many matches more than one are needed). Keys 1, 125 and 166 have rules of their own.
_Q, _QH = "[!#6;!#1]", "[!#6;!#1;!H0]"
KEYS = {
    2: ("[#104]", 0), 3: ("[#32,#33,#34,#50,#51,#52,#82,#83,#84]", 0), 4: ("[Ac,Th,Pa,U,Np,Pu,Am,Cm,Bk,Cf,Es,Fm,Md,No,Lr]", 0), 5: ("[Sc,Ti,Y,Zr,Hf]", 0), 6: ("[La,Ce,Pr,Nd,Pm,Sm,Eu,Gd,Tb,Dy,Ho,Er,Tm,Yb,Lu]", 0), 7: ("[V,Cr,Mn,Nb,Mo,Tc,Ta,W,Re]", 0), 8: (f"{_Q}1~*~*~*~1", 0), 9: ("[Fe,Co,Ni,Ru,Rh,Pd,Os,Ir,Pt]", 0),
    10: ("[Be,Mg,Ca,Sr,Ba,Ra]", 0), 11: ("*1~*~*~*~1", 0), 12: ("[Cu,Zn,Ag,Cd,Au,Hg]", 0), 13: ("[#8]~[#7](~[#6])~[#6]", 0), 14: ("[#16]-[#16]", 0), 15: ("[#8]~[#6](~[#8])~[#8]", 0), 16: (f"{_Q}1~*~*~1", 0), 17: ("[#6]#[#6]", 0), 18: ("[#5,#13,#31,#49,#81]", 0), 19: ("*1~*~*~*~*~*~*~1", 0),
    20: ("[#14]", 0), 21: (f"[#6]=[#6](~{_Q})~{_Q}", 0), 22: ("*1~*~*~1", 0), 23: ("[#7]~[#6](~[#8])~[#8]", 0), 24: ("[#7]-[#8]", 0), 25: ("[#7]~[#6](~[#7])~[#7]", 0), 26: ("[#6]=;@[#6](@*)@*", 0), 27: ("[I]", 0), 28: (f"{_Q}~[CH2]~{_Q}", 0), 29: ("[#15]", 0),
    30: (f"[#6]~{_Q}(~[#6])(~[#6])~*", 0), 31: (f"{_Q}~[F,Cl,Br,I]", 0), 32: ("[#6]~[#16]~[#7]", 0), 33: ("[#7]~[#16]", 0), 34: ("[CH2]=*", 0), 35: ("[Li,Na,K,Rb,Cs,Fr]", 0), 36: ("[#16R]", 0), 37: ("[#7]~[#6](~[#8])~[#7]", 0), 38: ("[#7]~[#6](~[#6])~[#7]", 0), 39: ("[#8]~[#16](~[#8])~[#8]", 0),
    40: ("[#16]-[#8]", 0), 41: ("[#6]#[#7]", 0), 42: ("F", 0), 43: (f"{_QH}~*~{_QH}", 0), 44: ("[!#1;!#6;!#7;!#8;!#9;!#14;!#15;!#16;!#17;!#35;!#53]", 0), 45: ("[#6]=[#6]~[#7]", 0), 46: ("Br", 0), 47: ("[#16]~*~[#7]", 0), 48: (f"[#8]~{_Q}(~[#8])(~[#8])", 0), 49: ("[!+0]", 0),
    50: ("[#6]=[#6](~[#6])~[#6]", 0), 51: ("[#6]~[#16]~[#8]", 0), 52: ("[#7]~[#7]", 0), 53: (f"{_QH}~*~*~*~{_QH}", 0), 54: (f"{_QH}~*~*~{_QH}", 0), 55: ("[#8]~[#16]~[#8]", 0), 56: ("[#8]~[#7](~[#8])~[#6]", 0), 57: ("[#8R]", 0), 58: (f"{_Q}~[#16]~{_Q}", 0), 59: ("[#16]!:*:*", 0),
    60: ("[#16]=[#8]", 0), 61: ("*~[#16](~*)~*", 0), 62: ("*@*!@*@*", 0), 63: ("[#7]=[#8]", 0), 64: ("*@*!@[#16]", 0), 65: ("c:n", 0), 66: ("[#6]~[#6](~[#6])(~[#6])~*", 0), 67: (f"{_Q}~[#16]", 0), 68: (f"{_QH}~{_QH}", 0), 69: (f"{_Q}~{_QH}", 0),
    70: (f"{_Q}~[#7]~{_Q}", 0), 71: ("[#7]~[#8]", 0), 72: ("[#8]~*~*~[#8]", 0), 73: ("[#16]=*", 0), 74: ("[CH3]~*~[CH3]", 0), 75: ("*!@[#7]@*", 0), 76: ("[#6]=[#6](~*)~*", 0), 77: ("[#7]~*~[#7]", 0), 78: ("[#6]=[#7]", 0), 79: ("[#7]~*~*~[#7]", 0),
    80: ("[#7]~*~*~*~[#7]", 0), 81: ("[#16]~*(~*)~*", 0), 82: (f"*~[CH2]~{_QH}", 0), 83: (f"{_Q}1~*~*~*~*~1", 0), 84: ("[NH2]", 0), 85: ("[#6]~[#7](~[#6])~[#6]", 0), 86: (f"[C;H2,H3]{_Q}[C;H2,H3]", 0), 87: ("[F,Cl,Br,I]!@*@*", 0), 88: ("[#16]", 0), 89: ("[#8]~*~*~*~[#8]", 0),
    90: (f"[$({_QH}~*~*~[CH2]~*),$([!#6;!#1;!H0;R]1@[R]@[R]@[CH2;R]1),$({_QH}~[R]1@[R]@[CH2;R]1)]", 0), 91: (f"[$({_QH}~*~*~*~[CH2]~*),$([!#6;!#1;!H0;R]1@[R]@[R]@[R]@[CH2;R]1),$({_QH}~[R]1@[R]@[R]@[CH2;R]1),$({_QH}~*~[R]1@[R]@[CH2;R]1)]", 0), 92: ("[#8]~[#6](~[#7])~[#6]", 0), 93: (f"{_Q}~[CH3]", 0), 94: (f"{_Q}~[#7]", 0),
    95: ("[#7]~*~*~[#8]", 0), 96: ("*1~*~*~*~*~1", 0), 97: ("[#7]~*~*~*~[#8]", 0), 98: (f"{_Q}1~*~*~*~*~*~1", 0), 99: ("[#6]=[#6]", 0), 100: ("*~[CH2]~[#7]", 0), 101: (_rings(8, 14), 0), 102: (f"{_Q}~[#8]", 0), 103: ("Cl", 0), 104: (f"{_QH}~*~[CH2]~*", 0),
    105: ("*@*(@*)@*", 0), 106: (f"{_Q}~*(~{_Q})~{_Q}", 0), 107: ("[F,Cl,Br,I]~*(~*)~*", 0), 108: ("[CH3]~*~*~*~[CH2]~*", 0), 109: ("*~[CH2]~[#8]", 0), 110: ("[#7]~[#6]~[#8]", 0), 111: ("[#7]~*~[CH2]~*", 0), 112: ("*~*(~*)(~*)~*", 0), 113: ("[#8]!:*:*", 0), 114: ("[CH3]~[CH2]~*", 0),
    115: ("[CH3]~*~[CH2]~*", 0), 116: ("[$([CH3]~*~*~[CH2]~*),$([CH3]~*1~*~[CH2]1)]", 0), 117: ("[#7]~*~[#8]", 0), 118: ("[$(*~[CH2]~[CH2]~*),$(*1~[CH2]~[CH2]1)]", 1), 119: ("[#7]=*", 0), 120: ("[!#6;R]", 1), 121: ("[#7;R]", 0), 122: ("*~[#7](~*)~*", 0), 123: ("[#8]~[#6]~[#8]", 0), 124: (f"{_Q}~{_Q}", 0),
    126: ("*!@[#8]!@*", 0), 127: ("*@*!@[#8]", 1), 128: ("[$(*~[CH2]~*~*~*~[CH2]~*),$([R]1@[CH2;R]@[R]@[R]@[R]@[CH2;R]1),$(*~[CH2]~[R]1@[R]@[R]@[CH2;R]1),$(*~[CH2]~*~[R]1@[R]@[CH2;R]1)]", 0), 129: ("[$(*~[CH2]~*~*~[CH2]~*),$([R]1@[CH2]@[R]@[R]@[CH2;R]1),$(*~[CH2]~[R]1@[R]@[CH2;R]1)]", 0),
    130: (f"{_Q}~{_Q}", 1), 131: (_QH, 1), 132: ("[#8]~*~[CH2]~*", 0), 133: ("*@*!@[#7]", 0), 134: ("[F,Cl,Br,I]", 0), 135: ("[#7]!:*:*", 0), 136: ("[#8]=*", 1), 137: ("[!C;!c;R]", 0), 138: (f"{_Q}~[CH2]~*", 1), 139: ("[O;!H0]", 0),
    140: ("[#8]", 3), 141: ("[CH3]", 2), 142: ("[#7]", 1), 143: ("*@*!@[#8]", 0), 144: ("*!:*:*!:*", 0), 145: ("*1~*~*~*~*~*~1", 1), 146: ("[#8]", 2), 147: ("[$(*~[CH2]~[CH2]~*),$([R]1@[CH2;R]@[CH2;R]1)]", 0), 148: (f"*~{_Q}(~*)~*", 0), 149: ("[C;H3,H4]", 1),
    150: ("*!@*@*!@*", 0), 151: ("[#7;!H0]", 0), 152: ("[#8]~[#6](~[#6])~[#6]", 0), 153: (f"{_Q}~[CH2]~*", 0), 154: ("[#6]=[#8]", 0), 155: ("*!@[CH2]!@*", 0), 156: ("[#7]~*(~*)~*", 0), 157: ("[#6]-[#8]", 0), 158: ("[#6]-[#7]", 0), 159: ("[#8]", 1),
    160: ("[C;H3,H4]", 0), 161: ("[#7]", 0), 162: ("a", 0), 163: ("*1~*~*~*~*~*~1", 0), 164: ("[#8]", 0), 165: ("[R]", 0),
}


#: Keys that are rings whole: their atoms and bonds are looked for in rings only, so that chains aren't walked.
RING_KEYS = {8, 11, 16, 19, 22, 83, 96, 98, 145, 163}


def structural_keys(g: str) -> Column:
    """The keys that are set, ascending, of 1 to 166; 125: two aromatic rings or more, 166: several fragments."""
    # A ring of n atoms is aromatic if it has n aromatic bonds; each is found 2 n times, once for every start and direction.
    aromatic = sum((count(g, f"a1{':a' * (n - 2)}:a:1") for n in range(3, 8)), F.lit(0))
    in_rings = lambda key, smarts: smarts.replace("*", "[R]").replace("~", "@") if key in RING_KEYS else smarts
    on = [F.when(has(g, in_rings(key, smarts), more + 1), key) for key, (smarts, more) in KEYS.items()]
    on += [F.when(aromatic > 1, 125), F.when(F.col(g)["fragments"] > 1, 166)]
    return F.when(F.col(g)["atoms"].isNotNull(), F.array_sort(F.array_compact(F.array(*on))))


# Groups that protect, link, tag or react, in the order in which they are looked for.
REMOVED = {
    "Boc": "[#6](=O)OC(C)(C)C", "Cbz": "[#6](=O)OCc1ccccc1", "Fmoc": "[#6](=O)OCC1c2ccccc2-c2ccccc21", "Acetyl": "[#6](=O)[CH3]", "TBS": "[Si](C)(C)C(C)(C)C", "Trityl": "C(c1ccccc1)(c1ccccc1)c1ccccc1",
    "Benzyl_ether": "[OX2]Cc1ccccc1", "PEG_linker": "OCCOCCOCC", "Biotin_tag": "C1CSC2CC(=O)NC12", "Azide_handle": "[N-]=[N+]=[N-]", "Alkyne_handle": "C#C",
}


def _without(smiles: Column, atoms: Column) -> Column:
    """The text of what is left without some atoms, open valences filled with hydrogen; null if nothing is left or it is no molecule."""

    def work(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, gone in batches:
            out = []
            for text, cut in zip(texts, gone, strict=True):
                if not isinstance(text, str) or cut is None:
                    out.append(None)
                    continue
                mol, cut = molecule.parse(text), set(cut)
                keep = [a for a in range(len(mol)) if a not in cut]
                try:
                    out.append(molecule.write(molecule.parse(molecule.write(mol.part(keep)))) if keep else None)
                except ValueError:
                    out.append(None)
            yield pd.Series(out, dtype=object)

    work.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(work, "string").asNondeterministic()(smiles, atoms)


def removed(df: DataFrame, smiles: str, groups: dict[str, str] | None = None, rounds: int = 5) -> DataFrame:
    """df with clean (text without the groups) and removed (their names, in turn).

    In each round the first group, in the table's order, that matches loses its first match; a cut that leaves no molecule isn't made and ends the row's rounds. A molecule without
    any group keeps its text; null and text that is no molecule give null. Other columns stay. Each distinct text goes through the rounds once.
    """
    table = REMOVED if groups is None else groups
    out = once(df, smiles, lambda texts: _rounds(texts, smiles, table, rounds))
    return out.withColumn("removed", F.coalesce("removed", F.array().cast("array<string>")))


def _rounds(df: DataFrame, smiles: str, table: dict[str, str], rounds: int) -> DataFrame:
    """The text column with clean and removed."""
    names = F.array(*[F.lit(n) for n in table])
    keep = df.columns
    out = df.select("*", F.col(smiles).alias("clean"), F.array().cast("array<string>").alias("removed"))
    for i in range(rounds):
        out = out.select(*keep, "clean", "removed", graph("clean").alias("rm_graph"))
        # The first match of each group; the first group that has one is cut.
        out = out.select("*", F.array(*[F.get(matches("rm_graph", p), F.lit(0)) for p in table.values()]).alias("rm_hits"))
        out = out.select("*", F.array_position(F.transform("rm_hits", lambda m: m.isNotNull()), F.lit(True)).cast("int").alias("rm_at"))
        out = out.select("*", _without(F.col("clean"), F.when(F.col("rm_at") > 0, F.get("rm_hits", F.col("rm_at") - 1))).alias("rm_rest"))
        clean = F.coalesce("rm_rest", "clean") if i else F.when(F.col("rm_graph.atoms").isNotNull(), F.coalesce("rm_rest", "clean"))
        names_now = F.when(F.col("rm_rest").isNotNull(), F.array_append("removed", F.get(names, F.col("rm_at") - 1))).otherwise(F.col("removed"))
        out = out.select(*keep, clean.alias("clean"), names_now.alias("removed"))
    return out


# Published atom types with what an atom adds to the logarithm of the partition coefficient and to the molar refractivity; the first type that fits counts.
_X, _ANY = "[A;!#1]", "[!#1;A,a]"
_HALO = "[N,O,P,S,F,Cl,Br,I]"
ATOMS = {
    6: [
        (["[CH4]", "[CH3]C", "[CH2](C)C"], 0.1441, 2.503), (["[CH](C)(C)C", "[C](C)(C)(C)C"], 0.0, 2.433), ([f"[CH3]{_HALO}", f"[CH2X4]({_HALO}){_X}"], -0.2035, 2.753), ([f"[CH1X4]({_HALO})({_X}){_X}", f"[CH0X4]({_HALO})({_X})({_X}){_X}"], -0.2051, 2.731), (["[C]=[!C;A;!#1]"], -0.2783, 5.007),
        (["[CH2]=C", f"[CH1](=C){_X}", f"[CH0](=C)({_X}){_X}", "[C](=C)=C"], 0.1551, 3.513), ([f"[CX2]#{_X}"], 0.0017, 3.888), (["[CH3]c"], 0.08452, 2.464), (["[CH3]a"], -0.1444, 2.412), (["[CH2X4]a"], -0.0516, 2.488), (["[CHX4]a"], 0.1193, 2.582), (["[CH0X4]a"], -0.0967, 2.576),
        (["[cH0]-[A;!C;!N;!O;!S;!F;!Cl;!Br;!I;!#1]"], -0.5443, 4.041), (["c[#9]"], 0.0, 3.257), (["c[#17]"], 0.2450, 3.853), (["c[#35]"], 0.1980, 2.673), (["c[#53]"], 0.0, 3.135), (["[cH]"], 0.1581, 3.350), (["c(:a)(:a):a"], 0.2955, 4.346), (["c(:a)(:a)-a"], 0.2713, 3.904), (["c(:a)(:a)-C"], 0.1360, 3.509),
        (["c(:a)(:a)-N"], 0.1839, 4.067), (["c(:a)(:a)-O"], 0.5437, 3.853), (["c(:a)(:a)-S"], 0.1893, 2.673), (["c(:a)(:a)=[C,N,O]"], -0.8186, 3.135), ([f"[C](=C)(a){_X}", "[C](=C)(c)a", "[CH1](=C)a", "[C]=c"], 0.2640, 4.305), (["[CX4][A;!C;!N;!O;!P;!S;!F;!Cl;!Br;!I;!#1]"], 0.2148, 2.693), (["[#6]"], 0.08129, 3.243),
    ],
    7: [
        ([f"[NH2+0]{_X}"], -1.019, 2.262), ([f"[NH+0]({_X}){_X}"], -0.7096, 2.173), (["[NH2+0]a"], -1.027, 2.827), ([f"[NH1+0]({_ANY})a"], -0.5188, 3.000), ([f"[NH+0]={_ANY}"], 0.08387, 1.757), ([f"[N+0](={_ANY}){_ANY}"], 0.1836, 2.428), ([f"[N+0]({_X})({_X}){_X}"], -0.3187, 1.839),
        ([f"[N+0](a)({_ANY}){_X}", "[N+0](a)(a)a"], -0.4458, 2.819), ([f"[N+0]#{_X}"], 0.01508, 1.725), (["[NH3,NH2,NH;+,+2,+3]"], -1.950, 0.0), (["[n+0]"], -0.3239, 2.202), (["[n;+,+2,+3]"], -1.119, 0.0),
        ([f"[NH0;+,+2,+3]({_X})({_X})({_X}){_X}", f"[NH0;+,+2,+3](={_X})({_X}){_ANY}", "[NH0;+,+2,+3](=[#6])=[#7]"], -0.3396, 0.2604), ([f"[N;+,+2,+3]#{_X}", "[N;-,-2,-3]", "[N;+,+2,+3](=[N;-,-2,-3])=N"], 0.2887, 3.359), (["[#7]"], -0.4806, 2.134),
    ],
    8: [
        (["[o]"], 0.1552, 1.080), (["[OH,OH2]"], -0.2893, 0.8238), ([f"[O]({_X}){_X}"], -0.0684, 1.085), ([f"[O](a){_ANY}"], -0.4195, 1.182), (["[O]=[#7,#8]", "[OX1;-,-2,-3][#7]"], 0.0335, 3.367), (["[OX1;-,-2][#16]", "[O;-0]=[#16;-0]"], -0.3339, 0.7774), (["[O-]C(=O)"], -1.326, 0.0), (["[OX1;-,-2,-3][!#1;!N;!S]"], -1.189, 0.0),
        (["[O]=c"], 0.1788, 3.135), (["[O]=[CH]C", f"[O]=C(C){_X}", "[O]=[CH][N,O]", "[O]=[CH2]", "[O]=[CX2]=O"], -0.1526, 0.0), (["[O]=[CH]c", "[O]=C([C,c])[a;!#1]", f"[O]=C(c){_X}"], 0.1129, 0.2215), (["[O]=C([!#1;!#6])[!#1;!#6]"], 0.4833, 0.3890), (["[#8]"], -0.1188, 0.6865),
    ],
    9: [(["[#9-0]"], 0.4118, 1.108), (["[#9]"], -2.996, 0.0)], 17: [(["[#17-0]"], 0.6895, 5.853), (["[#17]"], -2.996, 0.0)], 35: [(["[#35-0]"], 0.8456, 8.927), (["[#35]"], -2.996, 0.0)], 53: [(["[#53-0]"], 0.8857, 14.02), (["[#53]"], -2.996, 0.0)],
    15: [(["[#15]"], 0.8612, 6.920)], 16: [(["[S;-,-2,-3,-4,+,+2,+3,+5,+6]", "[S-0]=[N,O,P,S]"], -0.0024, 7.365), (["[S;A]"], 0.6482, 7.591), (["[s;a]"], 0.6237, 6.691)],
}
#: The same of the hydrogens on an atom that a pattern fits.
HYDROGENS = [(["[#6]"], 0.1230, 1.057), (["[#7]", "[#8][#7]"], 0.2142, 0.9627), (["[#8]C=[#6,#7,O,S]", "[#8][O,S]"], 0.2980, 1.805), (["[*]"], -0.2677, 1.395)]
#: And of atoms of any other element.
METAL = (-0.0025, 0.0)


def partition(g: str) -> Column:
    """struct<logp, refractivity>: sums of the published contributions of atoms and their hydrogens; null for no molecule."""
    i, x = "part_i", f"{g}.atoms[part_i]"

    def first(types: list, default: str) -> str:
        whens = [f"WHEN {' OR '.join(f'size({parse(p).found(g, f"array({i})")}) > 0' for p in patterns)} THEN array({logp}D, {mr}D)" for patterns, logp, mr in types]
        return f"CASE {' '.join(whens)} ELSE {default} END"

    nothing = f"array({METAL[0]}D, {METAL[1]}D)"
    heavy = "CASE " + " ".join(f"WHEN {x}.z = {z} THEN {first(types, nothing)}" for z, types in ATOMS.items()) + f" WHEN {x}.z <= 1 THEN array(0D, 0D) ELSE {nothing} END"
    light = f"CASE WHEN {x}.h = 0 OR {x}.z <= 1 THEN array(0D, 0D) ELSE {first(HYDROGENS, 'array(0D, 0D)')} END"
    each = f"transform(sequence(0, size({g}.atoms) - 1), {i} -> struct({heavy} AS a, {light} AS b, {x}.h AS h))"
    total = lambda k: f"aggregate({g}_each, 0D, (s, e) -> s + e.a[{k}] + e.h * e.b[{k}])"
    # The terms are made once and summed twice.
    both = f"transform(array({each}), {g}_each -> named_struct('logp', {total(0)}, 'refractivity', {total(1)}))[0]"
    return F.expr(f"CASE WHEN {g}.atoms IS NULL THEN NULL ELSE {both} END")
