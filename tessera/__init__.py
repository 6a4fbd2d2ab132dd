"""A Spark-native lake for molecular structures and the analysis of their metadata and atoms."""
