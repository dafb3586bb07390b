"""Symbol parsers: from a source text to definitions and references."""
