"""DataFrame -> DataFrame jobs, one module per stage of the miner."""
