"""Training-data operators: URL filters, secret scans, de-duplication,
decontamination, language-model scoring, token files, vector search,
toxicity and packing.  Nothing else in the library imports this package."""
