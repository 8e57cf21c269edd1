"""Landing-zone readers, sinks and the test-table adapters."""
