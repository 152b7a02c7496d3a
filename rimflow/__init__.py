"""rimflow: game-event analytics as PySpark DataFrame plans."""
