"""slipweave: Spark-first reconstruction of receipt text from line detections.

The package root stays import-light; import the submodule you need.
"""

__version__ = "0.1.0"
