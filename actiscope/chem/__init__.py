"""Molecule graphs: parsing, canonical text, standardisation, scaffolds, fingerprints and descriptors, pure Python in Arrow workers."""
