"""Sortilege: a Spark-native engine that audits recurring random draws."""
