"""Readers and writers: pixel tables, catalogs, configurations, metrics and mosaics."""
