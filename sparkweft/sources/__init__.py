"""Readers for tables and JSON documents."""
