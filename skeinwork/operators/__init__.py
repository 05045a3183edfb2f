"""Operators over DataFrames: property graphs, symbol resolution, chunks, retrieval and keyed state."""
