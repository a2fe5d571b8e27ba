"""starpipe: star-schema ETL with quality control, written as Spark DataFrame jobs."""
