"""doclake: documents, elements, vectors and document graphs as Spark tables."""
