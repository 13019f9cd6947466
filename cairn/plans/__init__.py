"""Whole jobs, and the building blocks that keep their tasks bounded."""
