"""Features on a stream of book updates."""
