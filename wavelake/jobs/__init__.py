"""Whole user jobs, built only from the operators."""
