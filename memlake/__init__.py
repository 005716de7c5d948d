"""memlake: a Spark-native memory, retrieval and corpus engine."""
