"""Whole validation runs: rule results, roll-up, gates and the run over many tables."""
