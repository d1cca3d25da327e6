"""A PySpark-native engine that prepares and audits text corpora for language-model training."""
