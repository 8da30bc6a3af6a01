"""Operators of a training-data pipeline; each module holds one operator and says what it does with odd input."""
