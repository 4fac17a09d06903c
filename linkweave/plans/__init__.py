"""Plans: derived inputs, the read registry and the query catalogue."""
