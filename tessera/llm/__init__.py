"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it.  Each module holds one operator;
:mod:`tessera.llm.queries` registers the thin ``opN_<name>`` queries over them.
"""
