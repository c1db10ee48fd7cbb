"""Training-data operators: decontamination, filters, extraction, classifiers, joins, mixing and sharding."""
