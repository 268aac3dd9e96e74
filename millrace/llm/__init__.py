"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; its queries are listed in
:mod:`millrace.llm.queries`.
"""
