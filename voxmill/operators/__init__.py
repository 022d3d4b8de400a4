"""DataFrame operators: cleaning, selection, aggregation, joins, clustering, reports."""
