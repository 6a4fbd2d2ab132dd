"""Table log, payload packs and structure formats."""
