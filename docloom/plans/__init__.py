"""Plans: derived inputs, composed jobs and the query catalogue."""
