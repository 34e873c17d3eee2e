"""Scalar functions and Arrow functions."""
