"""Files as tables: discovery, decoding, type inference and the readers."""
