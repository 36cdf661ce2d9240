"""filingsift: retrieval, checking and cleaning of large document collections on Spark."""
