"""Cairn: build, enrich, check and publish linked metadata graphs on Spark."""

from cairn.model import Graph

__all__ = ["Graph"]
