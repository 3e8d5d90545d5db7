"""Bundled grammars, lexers and a table-driven recogniser for source files."""
