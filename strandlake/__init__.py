"""strandlake: a PySpark-native engine for searching, aligning and clustering 3-D structures."""
