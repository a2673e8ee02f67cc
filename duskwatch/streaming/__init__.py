"""Streaming forms of the operators, each with its batch twin as the measure."""
