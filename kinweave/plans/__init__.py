"""Logical plans over contact networks."""
