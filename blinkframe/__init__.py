"""Spark-native analytics for event-camera localization streams."""
