"""cairn: place discovery and exploration analytics as PySpark DataFrame operators."""
