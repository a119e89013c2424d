"""Operators of a training-data pipeline over the corpus tables; nothing else in the library imports them."""
