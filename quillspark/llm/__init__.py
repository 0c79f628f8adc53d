"""Operators for preparing training text at corpus scale.

Self-contained: nothing else in the library imports this subpackage.
"""
