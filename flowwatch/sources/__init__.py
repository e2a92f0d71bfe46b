"""Readers, writers and the packet tables derived from `orders`."""
