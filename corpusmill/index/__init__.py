"""Stored indexes: vectors by lists and neighbour graphs with payload bitmaps, keywords by postings in blocks."""
