"""Operators for training data: each module holds one operator, ``queries`` registers them."""
