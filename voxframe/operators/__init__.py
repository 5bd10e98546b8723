"""Operators on voxel tables and cell tables; each takes and returns DataFrames keyed by vol_id."""
