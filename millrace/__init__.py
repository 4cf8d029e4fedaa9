"""A Spark-native analytics warehouse: catalog, tables with a commit log, queries and scripts."""
