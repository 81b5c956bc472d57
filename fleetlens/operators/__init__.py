"""Operators over long tables of (entity, time, value)."""
