"""Evidence-matrix ranking and text analytics, written for Spark."""
