"""headwater: Spark-native analytics over headlines, articles and social posts."""
