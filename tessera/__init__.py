"""A relational analytics engine on PySpark: typed scans and expressions, joins, aggregation, recursion, snapshot reads,
constraint-checked DML over versioned parquet tables, a three-level catalog and a small SQL shell."""
