"""Composed flows, ML stages, the query catalogue and its SQL oracles."""
