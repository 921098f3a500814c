"""Wave-pattern retrieval on PySpark: scoring, ranking, routing and snapshots of complex-valued vectors."""
