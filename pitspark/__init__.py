"""pitspark: point-in-time fundamentals as Spark DataFrame operators."""
