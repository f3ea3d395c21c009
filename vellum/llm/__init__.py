"""Training-data operators: scans, deduplication, scoring, archives, token tables and mixing."""
