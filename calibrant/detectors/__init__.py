"""Text classifiers as columns."""
