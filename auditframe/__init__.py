"""auditframe: Spark jobs for auditing labelled collections of sequences, vectors and text."""
