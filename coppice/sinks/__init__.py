"""Outputs: file report, node rows, flat lists, graph exports, packs, error rows."""
