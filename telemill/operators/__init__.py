"""Operators: plain ``DataFrame -> DataFrame`` functions over the three signals."""
