"""Data operations over segmented, annotated text collections, as Spark DataFrame operators."""
