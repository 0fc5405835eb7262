"""Column helpers (money, text, periods) and distributed building blocks (ids, scans)."""
