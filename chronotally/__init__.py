"""Agent-history analytics and corpus preparation on PySpark."""
