"""Operators for training data made of source code, documents and question logs."""
