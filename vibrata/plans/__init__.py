"""Whole analyses composed of operators, and the registered queries."""
