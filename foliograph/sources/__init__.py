"""Readers and writers: block tables from tables, CSV, token corpora, JSON and binary documents; outlines to JSON and CSV."""
