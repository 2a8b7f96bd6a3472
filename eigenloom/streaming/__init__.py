"""Empty on purpose: every analysis reads finite tables, and none has an incremental counterpart."""
