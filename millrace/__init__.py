"""Evidence analytics for document corpora, expressed as Spark DataFrame plans."""
