"""Inputs: file trees, manifests, tables, ignore rules, commit logs, status and diff text."""
