"""strataform: structural point-cloud analytics expressed as Spark plans."""
