"""DataFrame-to-DataFrame operators of the corpus audit."""
