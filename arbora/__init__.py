"""Object-graph analytics on Spark DataFrames.

``operators`` and ``functions`` are the DataFrame/Column layer, ``lang`` compiles
the two text languages onto it, ``plans`` holds the declared query pipeline.
"""

__version__ = "0.1.0"
