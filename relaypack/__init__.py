"""relaypack: batch compilation of agent and conversation histories into budgeted context packets, on Spark."""
