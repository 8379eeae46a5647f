"""Operators that prepare corpora for training; nothing outside this subpackage imports it."""
