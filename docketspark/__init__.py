"""docketspark: document-intake analytics expressed as Spark DataFrame jobs."""
