"""Code-graph analytics on DataFrames."""
