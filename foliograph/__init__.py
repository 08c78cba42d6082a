"""Document-structure analytics and training-data preparation on PySpark."""
