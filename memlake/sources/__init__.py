"""Stored tables, chat sources and scratch storage."""
