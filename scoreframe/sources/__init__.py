"""Readers, writers, case generators and providers."""
