"""millrace: training-data preparation and analysis as Spark jobs."""
