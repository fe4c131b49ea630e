"""Tidemark: audit analytics and corpus review operators on the DataFrame API."""
