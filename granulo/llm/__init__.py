"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; :mod:`granulo.llm.registry` lists its queries.
"""
