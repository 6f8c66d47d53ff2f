"""Operators of a training-data pipeline: one module each, with their query catalogue in ``queries``."""
