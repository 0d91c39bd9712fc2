"""Governed metrics on Spark: declarative metrics, intents, governance and quality over DataFrames."""
