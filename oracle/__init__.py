"""Reference answers in plain SQL, written independently of the DataFrame code and used only to check it."""
