"""Provenance graphs and corpus operators as Spark plans."""
