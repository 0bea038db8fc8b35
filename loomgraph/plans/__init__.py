"""Registered queries."""

from loomgraph.plans import catalogue, composed, extraction, files, graphs, libraries, records, streams, texts

__all__ = ["catalogue", "composed", "extraction", "files", "graphs", "libraries", "records", "streams", "texts"]
