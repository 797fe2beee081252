"""Vellum: document-privacy analytics expressed as Spark DataFrame plans."""
