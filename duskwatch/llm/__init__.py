"""Operators for preparing training data: extraction, filters, joins, packing, archives."""
