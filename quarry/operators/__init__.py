"""Operators of the object model as DataFrame transformations."""
