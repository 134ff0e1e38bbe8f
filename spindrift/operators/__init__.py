"""DataFrame operators: batches, groups, joins, filters, sampling, packing, retrieval, metrics."""
