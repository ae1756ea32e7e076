"""folioflow: document-structure and reading analytics as Spark DataFrame jobs."""
