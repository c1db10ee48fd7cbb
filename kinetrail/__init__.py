"""kinetrail: trajectory, sample-building and annotation operators on PySpark DataFrames."""
