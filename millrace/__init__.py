"""millrace: corpus assembly, leakage audit and prediction scoring as PySpark plans."""
