"""Tables derived from the test data and the registered queries."""
