"""Readers and writers: document files, record tables, uploads and run directories."""
