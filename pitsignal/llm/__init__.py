"""Training-data operators over the text of recorded tool results (`evidence`)."""
