"""DataFrame -> DataFrame operators: features, preparation, clustering, metrics."""
