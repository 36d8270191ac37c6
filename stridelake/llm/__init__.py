"""Training-data operators: quality, deduplication, tokens, urls, mixing, licences, html."""
