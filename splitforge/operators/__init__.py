"""Generic operators on entities, groups, signatures, counts, pairs, clusters, splits and metrics."""
