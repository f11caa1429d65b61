"""Patrol planning analytics on Spark: cleaning, clustering, prizes, robust route evaluation and statistics."""
