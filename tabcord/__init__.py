"""Table-consistency operators for PySpark.

Every operator is a function from DataFrames (plus column names and
thresholds) to a lazy DataFrame; ``tabcord.plans`` binds the operators to the
``tbl_*`` conventions and rolls their results up into findings.
"""
