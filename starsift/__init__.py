"""starsift: anomaly triage over large collections, written with the PySpark DataFrame API."""
