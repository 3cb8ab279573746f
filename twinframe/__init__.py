"""A PySpark-native engine that compares and synchronises snapshots of relational data."""
