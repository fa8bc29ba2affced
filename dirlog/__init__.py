"""dirlog: directory-server log analytics as Spark jobs."""
