"""docquarry: document, vector and entity-graph analytics written as Spark jobs."""

__version__ = "0.1.0"
