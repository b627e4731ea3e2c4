"""Picture-evidence analytics as lazy Spark plans."""
