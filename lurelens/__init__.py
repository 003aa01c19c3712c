"""lurelens: brand-imitation URL-risk analytics on Spark."""
