"""helixframe: sequence-graph analytics on PySpark DataFrames."""
