"""DataFrame operators: filters, joins, ordering, aggregates, paging."""
