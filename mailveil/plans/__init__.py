"""Whole queries made of the functions and operators."""
