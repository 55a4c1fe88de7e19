"""threatsift: Spark-native message and URL threat analytics."""

__version__ = "0.1.0"
