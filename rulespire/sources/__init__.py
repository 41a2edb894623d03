"""Readers, writers and labelled tasks on tables."""
