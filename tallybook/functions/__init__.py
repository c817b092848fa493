"""Column expressions: text, money, dates, hashing, cells."""
