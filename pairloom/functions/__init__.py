"""Column functions: text in, text or token ids out. None of them shuffles."""
