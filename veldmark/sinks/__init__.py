"""Where converted documents go."""
