"""Flood-grid refinement and analysis on Spark: grids are tables of cells."""
