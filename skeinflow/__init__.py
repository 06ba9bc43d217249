"""Exact combinatorial and homological invariants of knot diagrams at batch scale, on Spark DataFrames."""

#: Of the library, as results name it.
VERSION = "0.3"
