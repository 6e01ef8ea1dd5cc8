"""Point-in-time panels, peer scores, motion, crowding, exits and portfolios as Spark jobs."""
