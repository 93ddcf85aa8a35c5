"""siltstone: Spark-native data discovery, view synthesis and view comparison."""
