"""Operators over tables of diagrams: cubes of resolutions, Seifert forms, grids, complexes and their homology."""
