"""Composed plans: the registered query catalog, model comparison and the
quick preview built from the operators."""
