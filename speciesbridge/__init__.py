"""Reconciliation of entity names across large tables and trees, on Spark DataFrames."""
