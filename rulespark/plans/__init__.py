"""From normal rules to ordered steps, and from steps to DataFrames."""
