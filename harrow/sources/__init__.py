"""Feeds of postings: what each vendor's payloads hold, and how a posting is built from them."""
