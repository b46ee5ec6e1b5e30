"""Table reconciliation, drift analytics and corpus preparation on Spark."""
