"""tessera: a PySpark-native engine for indexing, searching and analysing source code and text corpora."""
