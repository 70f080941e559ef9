"""From mapping models to columns and DataFrames."""
