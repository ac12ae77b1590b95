"""Registered queries, the engine and the command line."""
