"""Document analytics on Spark: DataFrame-to-DataFrame operators over page, block and unit records."""
