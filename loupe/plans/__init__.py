"""Plans: the query registry, the spot-check leaderboard and the end-to-end flow."""
