"""Jobs that go on where they stopped: run records as a file stream."""
