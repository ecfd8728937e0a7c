"""Relational operators over pixels, nodes, edges and members."""
