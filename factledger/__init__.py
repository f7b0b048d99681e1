"""Registry jobs on Spark: DataFrame -> DataFrame functions for master data."""
