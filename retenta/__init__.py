"""retenta: retention, lifetime-value and first-order modelling analytics on Spark.

Every capability is a function that takes DataFrames (or a SparkSession and a
table source) and returns a lazy DataFrame; nothing is collected unless the
caller asks for a scalar or a bounded, small table.
"""

__version__ = "0.1.0"
