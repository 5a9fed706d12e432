"""Whole jobs: aggregation of documents, the workflow, reports."""
