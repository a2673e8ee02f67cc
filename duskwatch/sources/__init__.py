"""Readers: JSON lines of sensors, hosts and runs, text corpora, catalogues, inventories."""
