"""Readers and writers (SRC1-SRC14, SNK1-SNK10)."""
