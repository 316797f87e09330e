"""Text-forensics features, scoring and evaluation as Spark DataFrame jobs."""
