"""foliary: document and corpus analytics as Spark DataFrame jobs."""
