"""Typed-decision analytics and training-data operators on PySpark."""
