"""Document-corpus analytics as plain DataFrame -> DataFrame functions on Spark."""
