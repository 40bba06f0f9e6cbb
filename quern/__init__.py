"""quern: a Spark-native engine for indexing, searching and preparing web text."""
