"""Document shortening and summary evaluation as Spark DataFrame operators."""
