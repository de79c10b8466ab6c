"""lodeworks: corpus curation, retrieval analytics and evaluation as Spark jobs."""
