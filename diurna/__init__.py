"""diurna: wearable-lifelog analytics as Spark DataFrame operators."""
