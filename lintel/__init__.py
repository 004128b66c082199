"""Spark jobs for building-model and document analytics."""
