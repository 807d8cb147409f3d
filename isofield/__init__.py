"""isofield: Spark-native field reconstruction and experiment-table analytics."""
