"""PySpark-native sequence-composition analytics."""
