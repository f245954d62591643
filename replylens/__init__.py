"""Support-conversation analytics as plain Spark DataFrame operators."""
