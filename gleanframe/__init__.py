"""gleanframe: a Spark-native engine for curating training sets."""
