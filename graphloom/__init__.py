"""graphloom: documents to knowledge graphs as Spark DataFrame plans."""
