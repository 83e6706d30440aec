"""statloom: document-collection analytics as Spark DataFrame operators."""
