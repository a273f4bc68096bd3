"""Readers and writers: typed tables, JSON lines, CSV, generations and keyed stores."""
