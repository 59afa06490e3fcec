"""Lectern: content-analytics operators for Spark DataFrames.

Layers: ``sources`` read and write, ``functions`` are column expressions, ``operators`` are
DataFrame-to-DataFrame steps, ``plans`` wires operators to tables and registers named queries,
``streaming`` holds the Structured Streaming twins.
"""
