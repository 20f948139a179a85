"""Whole render plans composed of operators."""
