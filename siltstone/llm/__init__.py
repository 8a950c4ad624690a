"""Operators for language-model text. Nothing outside this subpackage imports it."""
