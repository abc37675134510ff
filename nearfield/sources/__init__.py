"""Readers and feature builders."""
