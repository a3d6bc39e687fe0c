"""Inputs and outputs: dictionaries, configuration, requests, JSON lines, the vault table."""
