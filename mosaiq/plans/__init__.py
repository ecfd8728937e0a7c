"""Plan-level tools: lineage cuts and gapless ranks."""
