"""Corpus analytics on Spark: files, lines, chunks, edges, scores and budgeted packs as DataFrames."""
