"""quartzfold: protein-library analytics and training-data operators on PySpark."""
