"""Analyses of annotated cell-by-gene matrices as Spark DataFrame plans."""
