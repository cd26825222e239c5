"""Change-data lakehouse toolkit on PySpark: DataFrame-to-DataFrame operators."""
