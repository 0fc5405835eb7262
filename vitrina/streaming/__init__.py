"""Event operators (ledger, rates, limits, cart life) and their streaming jobs."""
