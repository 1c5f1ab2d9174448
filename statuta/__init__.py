"""Spark-native engine that turns page-level legal text into audited, classifiable statements."""
