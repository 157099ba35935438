"""DataFrame operators: filters, joins, deduplication, aggregates, windows, sampling, sets, validation."""
