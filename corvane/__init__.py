"""corvane: a Spark-native retrieval and corpus analytics engine."""
