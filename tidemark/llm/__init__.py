"""Training-data operators: filtering, de-duplication, tokenising and search over text corpora."""
