"""trackloom: a Spark-native engine for video-event analytics and retrieval."""
