"""Named queries."""

from ragloom.plans import bookkeeping, files, ingest, lookups, search, serving, streams, texts

__all__ = ["bookkeeping", "files", "ingest", "lookups", "search", "serving", "streams", "texts"]
