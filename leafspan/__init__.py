"""Leafspan: section-tree and document analytics for large corpora, on Spark DataFrames."""
