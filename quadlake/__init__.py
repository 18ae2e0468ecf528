"""quadlake: graph queries over columnar tables with Spark."""
