"""lexiloom: Spark-native document extraction and corpus analytics."""
