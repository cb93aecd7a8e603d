"""logfold: a change-log engine on PySpark DataFrames."""
