"""Whole plans: correction, placement, evaluation."""
