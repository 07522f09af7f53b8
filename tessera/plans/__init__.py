"""Session set-up, table loading and materialisation helpers."""
