"""talus: catalog analytics and training-data preparation as Spark jobs."""
