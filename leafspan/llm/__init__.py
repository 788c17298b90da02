"""Training-data operators: cleaning, de-duplication, scanning, tokenising and packing of corpora."""
