"""Analytics over software knowledge graphs, as Spark DataFrames.

``functions`` holds column functions, ``operators`` the relational, graph and
domain operators, ``sources`` readers and extractors, ``streaming`` the job
stream, and ``plans`` the queries over the driver's tables.
"""
