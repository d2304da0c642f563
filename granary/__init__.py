"""granary: a PySpark-native engine for packed-asset catalogues and training-data corpora."""
