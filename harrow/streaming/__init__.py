"""Ingestion in steps: each takes the stored snapshot and what was fetched, and leaves the next snapshot."""
