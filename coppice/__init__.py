"""coppice: analytics over collections of file trees, as Spark DataFrame jobs.

Every operator is a function from DataFrames to a DataFrame.  Rows are keyed by
``(repo, snapshot, path)``; one directory on disk is just the case of one
``repo`` value.
"""
