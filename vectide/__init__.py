"""A vector search and table engine on PySpark."""
