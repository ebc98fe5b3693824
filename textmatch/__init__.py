"""Text-to-record matching and ranking evaluation as PySpark DataFrame plans."""
