"""Importing this module registers every query."""

from catalog import checks, cleaning, evaluation, grouped, profile, signals, texts  # noqa: F401
