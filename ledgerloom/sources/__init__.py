"""Readers: tables, archives, XML, magic bytes."""
