"""Ravelin: threat-intelligence analytics and training-data preparation on PySpark."""
