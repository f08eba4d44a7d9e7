"""Operators for preparing training text, one module per operator.

Nothing else in the package imports this folder; ``queries.py`` registers one
``opN_<name>`` query per operator.
"""
