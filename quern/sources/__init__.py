"""Inputs: table readers and adapter views."""
