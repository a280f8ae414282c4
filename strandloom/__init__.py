"""Strandloom: genome similarity analytics and corpus-scale data operators on PySpark DataFrames."""

__version__ = "0.1.0"
