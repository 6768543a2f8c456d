"""tickloom: equity-research analytics expressed as Spark DataFrame jobs.

Every operator takes DataFrames and returns a lazy DataFrame over all symbols at
once.  See README.md for the module map.
"""
