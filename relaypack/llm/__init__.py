"""Training-data operators. Nothing else in relaypack imports this subpackage."""
