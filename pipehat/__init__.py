"""Spark-native HL7 v2.x message analytics."""
