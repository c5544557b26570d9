"""A PySpark-native engine for Flexible Image Transport System files."""
