"""Dossier: document-evidence and review analytics on Spark DataFrames."""
