"""Multi-label learning over Spark ML."""
