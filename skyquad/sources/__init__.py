"""Readers: star catalogs, pictures, star lists, deep-sky objects, benchmark output."""

from .registry import reader_for, register_reader

__all__ = ["reader_for", "register_reader"]
