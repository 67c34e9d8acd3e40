"""corpusmill: a PySpark-native engine for captured web pages and text corpora."""
