"""marlspike: a Spark-first engine for document logs, standing queries and change feeds."""
