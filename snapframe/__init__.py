"""PySpark-native analytics over frame-level motion tables and text corpora."""
