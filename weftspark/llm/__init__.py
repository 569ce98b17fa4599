"""Operators for preparing large text collections, each a module; queries.py registers one query per operator."""
