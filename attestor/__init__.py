"""attestor: a Spark-native engine for claim/evidence verification analytics."""
