"""A Spark-native analytics engine: relational, nested, cleaning, versioned-table,
streaming, graph and text operators expressed over DataFrames and Spark SQL."""

__version__ = "0.1.0"
