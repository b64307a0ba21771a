"""navpulse: Spark jobs for exchange-traded fund market data.

Raw archived responses become typed tables, one row per fund and minute, repaired and
flagged against the previous row, and from there the reports an investor or an operator
asks for. Everything is a lazy DataFrame plan; nothing runs until the caller acts on it.
"""
