"""PySpark-native profiling, project-metadata, lineage and graph analytics."""
