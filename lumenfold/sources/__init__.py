"""Readers and writers of light curves, tables and configuration."""
