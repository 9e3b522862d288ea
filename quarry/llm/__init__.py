"""Training-data operators: filters, classifiers, scans, joins and searches over a text corpus."""
