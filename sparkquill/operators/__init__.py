"""DataFrame operators: index, ranking, rewriting, fusion, evaluation."""
