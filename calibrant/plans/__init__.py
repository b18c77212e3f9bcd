"""Query plans over the corpus and its scores."""
