"""Readers and writers for station archives, auxiliary series, reports and models."""
