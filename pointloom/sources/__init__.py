"""Catalogs: from tables, raw binary files, FITS tables, generators; and sinks for result tables."""
