"""Part of the fact extraction and reconciliation engine."""
