"""lectern: document-library analytics expressed as Spark plans."""
