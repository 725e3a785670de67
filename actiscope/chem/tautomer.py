"""Proton shifts: a hydrogen goes from one atom to another of the same conjugated system, and the double bonds between them move on."""

from __future__ import annotations

from . import graph
from .graph import AROMATIC, Atom, Mol

#: Bonds between two hetero atoms that a hydrogen may pass.
FARTHEST = 8


def kekule(mol: Mol) -> Mol:
    """The molecule with single and double bonds in place of aromatic ones."""
    pairs = mol.double_bonds()
    atoms = [Atom(x.symbol, False, x.charge, x.h, x.isotope) for x in mol.atoms]
    return Mol(atoms, [{b: (2 if frozenset((a, b)) in pairs else 1) if o == AROMATIC else o for b, o in n.items()} for a, n in enumerate(mol.bonds)])


def _ways(mol: Mol, x: int, most: int) -> list[list[int]]:
    """Ways from x along single, double, single, ... double bonds that end with a double bond, of at most `most` bonds."""
    out, todo = [], [[x]]
    while todo:
        way = todo.pop()
        order = 2 if len(way) % 2 == 0 else 1
        for b, o in mol.bonds[way[-1]].items():
            if o == order and b not in way and not mol.atoms[b].charge:
                new = [*way, b]
                if order == 2:
                    out.append(new)
                if len(new) <= most:
                    todo.append(new)
    return out


def shifts(mol: Mol) -> list[Mol]:
    """All molecules one shift away.

    Between N, O, S and Se the hydrogen may pass up to FARTHEST bonds; between one of these and a carbon, that isn't aromatic, two (keto and enol, imine and enamine).
    """
    plain, found, own = kekule(mol), {}, graph.write(mol)
    hetero = lambda a: plain.atoms[a].symbol in ("N", "O", "S", "Se")
    for x, atom in enumerate(plain.atoms):
        saturated = all(o == 1 for o in plain.bonds[x].values())
        if not atom.h or atom.charge or not saturated or not (hetero(x) or atom.symbol == "C"):
            continue
        for way in _ways(plain, x, FARTHEST if hetero(x) else 2):
            y = way[-1]
            carbon = not hetero(y)
            if (carbon and (plain.atoms[y].symbol != "C" or not hetero(x) or len(way) > 3)) or (not hetero(x) and carbon):
                continue
            if (carbon or not hetero(x)) and any(mol.atoms[a].aromatic for a in way):
                continue
            atoms = [Atom(z.symbol, False, z.charge, z.h, z.isotope) for z in plain.atoms]
            bonds = [dict(n) for n in plain.bonds]
            atoms[x].h, atoms[y].h = atoms[x].h - 1, atoms[y].h + 1
            for a, b in zip(way, way[1:], strict=False):
                bonds[a][b] = bonds[b][a] = 3 - bonds[a][b]
            text = graph.write(Mol(atoms, bonds))
            try:
                new = graph.parse(text)
            except ValueError:
                continue
            found.setdefault(graph.write(new), new)
    return [new for text, new in found.items() if text != own]
