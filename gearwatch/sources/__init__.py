"""Readers, writers and panel adapters."""
