"""Relational operators over inventories, bodies, edges and histories."""
