"""Verification of case files at scale, as Spark jobs over tables of documents."""
