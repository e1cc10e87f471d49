"""Spark-native engine for joining and sorting keyed relations and for metering the resource use of such work."""
