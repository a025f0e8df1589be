"""Abbreviation resolution, scoring and lineage over text corpora, as Spark DataFrames."""
