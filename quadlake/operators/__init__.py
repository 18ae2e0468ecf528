"""Operators over solution tables and over stored quads."""
