"""Linking, filling and comparing tables of dialogue lines with Spark."""
